"""BPE encoding and decoding with a pair occurrence index.

The pieces of a block of texts are laid out as one row of symbols with walls
between them. An index maps each mergeable pair, by its rank, to all positions
where it stands; the ranks that occur are applied in ascending order, each to
all its positions at once, and every merge enters the two new neighbouring
pairs into their lists. A merge of rank r can only create pairs of a higher
rank (``Vocabulary`` verifies this for the file), so no rank is met twice.

Null text counts as empty: no ids, an empty decoded text. Empty tables give
empty results, repeated rows give repeated results, and columns other than the
id and the text are not looked at.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_names

#: Distinct chunks whose ids a task remembers; beyond it, it starts anew.
CACHE_CHUNKS = 250_000
#: Characters of text that are encoded at a time, and texts whose ids are given out at a time.
BLOCK_CHARS, PART_TEXTS = 4_000_000, 500
#: Symbols whose pairs are looked up at a time.
_STEP = 1 << 16
_SHIFT = 17
_WALL, _GONE = -1, -2
#: stands before a chunk that is a special token; a space, which parts all other chunks
_MARK = " "
#: Control characters that str.split() takes for white space and the vocabulary's pattern does not.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\p{Zs}\p{Zl}\p{Zp}]+")


def _byte_chars() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file with an end-of-word suffix, as the tokenizers
    library writes it."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {i: -1 for i in [*self.inner.tolist(), *self.last.tolist()]}
        parts = np.zeros((len(merges), 3), np.int64)
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in made or made.get(x, rank) >= rank or made.get(y, rank) >= rank:
                raise ValueError(f"merge {rank} isn't newer than its parts: {a!r} {b!r}")
            made[z] = rank
            parts[rank] = x, y, z
        self.by_rank = parts
        keys = parts[:, 0] << _SHIFT | parts[:, 1]
        self.key_ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_ranks]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.tokens = [names.get(i) for i in range(max(names) + 1)]
        self.names = pa.array(self.tokens, pa.string())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall

    def _ranks(self, pair: np.ndarray) -> np.ndarray:
        slot = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[slot] == pair, self.key_ranks[slot], -1)

    def index_encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each piece has."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        if not len(sizes):
            return np.zeros(0, np.int32), sizes
        flat = np.frombuffer(b"".join(raw), np.uint8)
        del raw
        walls = np.concatenate([[0], np.cumsum(sizes + 1)])
        sym = np.full(walls[-1] + 1, _WALL, np.int32)
        inside = np.ones(len(sym), bool)
        inside[walls] = False
        sym[inside] = self.inner[flat]
        sym[walls[1:] - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        del flat, inside
        place = np.int32 if len(sym) < 2**31 else np.int64
        nxt, prv = np.arange(1, len(sym) + 1, dtype=place), np.arange(-1, len(sym) - 1, dtype=place)

        index = _Places(place)
        index.enter(*self._pairs_of(sym, place))
        while index.ranks:
            r, p = index.pop()
            a, b, new = self.by_rank[r].tolist()
            p = p[(sym[p] == a) & (sym[nxt[p]] == b)]
            if a == b and len(p) > 1:  # of overlapping places in a run, every other one counts, from the left
                p.sort()
                i = np.arange(len(p))
                head = np.concatenate([[True], nxt[p[:-1]] != p[1:]])
                p = p[(i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0]
            if not len(p):
                continue
            q = nxt[p]
            right = nxt[q]
            sym[p], sym[q] = new, _GONE
            nxt[p], prv[right] = right, p
            left = prv[p]
            left = left[(sym[left] >= 0) & (sym[left] != new)]  # beside another merge, that one's right pair is it
            p = p[sym[nxt[p]] >= 0]
            pos = np.concatenate([left, p])
            found = self._ranks(sym[pos].astype(np.int64) << _SHIFT | sym[nxt[pos]])
            ok = found >= 0
            index.enter(found[ok], pos[ok])
        ends = np.cumsum(sym != _GONE, dtype=place)[walls]
        return sym[sym >= 0], np.diff(ends).astype(np.int64) - 1

    def _pairs_of(self, sym: np.ndarray, place: type) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the mergeable pairs in a row of symbols, and their places."""
        ranks, at = [], []
        for i in range(0, len(sym) - 1, _STEP):
            x = sym[i : i + _STEP + 1].astype(np.int64)
            rank = self._ranks(np.where((x[:-1] >= 0) & (x[1:] >= 0), x[:-1] << _SHIFT | x[1:], -1))
            ok = np.flatnonzero(rank >= 0)
            ranks.append(rank[ok].astype(np.int32))
            at.append((ok + i).astype(place))
        return np.concatenate(ranks), np.concatenate(at)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: the tokens joined by a space, as the library
        does where the file names no decoder; ids it doesn't know are skipped."""
        names = self.names
        flat, offsets = ids.values, ids.offsets.to_numpy()
        ok = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), False)
        flat = pc.if_else(ok, flat, pa.scalar(None, pa.int32()))
        words = names.take(flat)
        if words.null_count:
            good = pc.is_valid(words).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(good)])[offsets]
            words = words.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


class _Places:
    """The index from ranks to places: arrays where many are entered at a time,
    lists for those that come one by one."""

    def __init__(self, place: type):
        self.place = place
        self.many: dict[int, list[np.ndarray]] = {}
        self.few: dict[int, list[int]] = {}
        self.ranks: list[int] = []  # a heap

    def enter(self, ranks: np.ndarray, at: np.ndarray) -> None:
        if len(at) < 32:
            for r, p in zip(ranks.tolist(), at.tolist(), strict=True):
                if r in self.few:
                    self.few[r].append(p)
                else:
                    self._note(r)
                    self.few[r] = [p]
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])).tolist()
        for r, i, j in zip(ranks[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
            self._note(r)
            if j - i < 8:
                self.few.setdefault(r, []).extend(at[i:j].tolist())
            else:
                self.many.setdefault(r, []).append(at[i:j])

    def _note(self, r: int) -> None:
        if r not in self.few and r not in self.many:
            heapq.heappush(self.ranks, r)

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and all its places."""
        r = heapq.heappop(self.ranks)
        parts = self.many.pop(r, [])
        if r in self.few:
            parts.append(np.array(self.few.pop(r), self.place))
        return r, parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Encoder:
    """Encodes texts in blocks and remembers the ids of chunks between spaces,
    which no piece crosses."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _chunks(self, text: str) -> list[str]:
        special = self.vocab.special
        if special and "<|" in text and any(s in text for s in special):
            out: list[str] = []
            for k, part in enumerate(self.vocab.special_at.split(text)):
                # the odd parts are special tokens, spelled as the file spells them; no plain chunk has the mark
                out += [_MARK + part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        # lower() turns a final capital sigma into its final form; the library goes letter by letter
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [c for c in _SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()

    def add(self, text: str | None) -> np.ndarray:
        """Numbers of the text's chunks, for ids_of() of the same block."""
        chunks = self._chunks(text) if text else []
        return np.fromiter(map(self.known.__getitem__, chunks), np.int32, len(chunks))

    def ids_of(self, block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each text has; all chunks
        are learned."""
        chunks = np.concatenate([*block, np.zeros(0, np.int32)])
        sizes = self.sizes[chunks]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[chunks] - (ends - sizes), sizes)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in block])]).astype(np.int64)])

    def _learn(self) -> None:
        special, pieces = self.vocab.special, self.vocab.pieces
        number = _Numbers()
        order, cuts = array("q"), array("q")
        for c in self.known.fresh:  # letters alone, with a stop or comma or without, are cut as the pattern would
            if c.isalpha():
                cut = (c,)
            elif c[-1] in ".," and c[:-1].isalpha():
                cut = (c[:-1], c[-1])
            else:
                cut = [c] if c[0] == _MARK else pieces(c)
            order.extend(map(number.__getitem__, cut))
            cuts.append(len(cut))
        self.known.fresh = []
        order, cuts = np.array(order, np.int64), np.array(cuts, np.int64)
        plain = [p for p in number if p[0] != _MARK]
        flat, sizes = self.vocab.index_encode(plain)
        if len(plain) < len(number):
            for i, p in enumerate(number):
                if p[0] == _MARK:
                    at = int(sizes[:i].sum())
                    flat, sizes = np.insert(flat, at, special[p[1:]]), np.insert(sizes, i, 1)
        starts = np.cumsum(sizes) - sizes
        each = sizes[order]
        ends = np.cumsum(each)
        got = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[order] - (ends - each), each)]
        per = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(cuts)])])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(per) - per])
        self.sizes = np.concatenate([self.sizes, per])
        self.flat = np.concatenate([self.flat, got])

    def blocks(self, rows: Iterable[tuple[object, str | None]]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Keys of some rows, their ids in a row, and how many each has."""
        keys, block, size = [], [], 0
        for key, text in rows:
            keys.append(key)
            block.append(self.add(text))
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield from self._given(keys, block)
                keys, block, size = [], [], 0
        if keys:
            yield from self._given(keys, block)

    def _given(self, keys: list, block: list[np.ndarray]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        self._learn()
        for i in range(0, len(keys), PART_TEXTS):
            yield keys[i : i + PART_TEXTS], *self.ids_of(block[i : i + PART_TEXTS])
        if len(self.known) > CACHE_CHUNKS:
            self._forget()


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: (id, ids array<int>). With decoded, also
    the text that decode() makes of them, in the same pass."""
    check_names(id_col, ("ids", "decoded"))
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocab_path))  # a file of fixed size
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None

        def pairs() -> Iterator[tuple[object, str | None]]:
            nonlocal at
            for batch in batches:
                at = batch.schema.field(0).type
                for part in _parts(batch):
                    yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

        vocab = vocabulary(shared.value)
        for keys, flat, counts in Encoder(vocab).blocks(pairs()):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            whole = pa.RecordBatch.from_arrays([pa.array(keys, at), pa.ListArray.from_arrays(offsets, pa.array(flat))], [id_col, "ids"])
            for part in _parts(whole, 200):
                ids = pa.concat_arrays([part.column(1)])
                text = [vocab.decode(ids)] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *text], fields)

    fields = [id_col, "ids", "decoded"][: 2 + decoded]
    kinds = [df.schema[id_col].dataType, T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(fields, kinds, strict=False)])
    return rows.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds the text of each list of ids: (id, ids, decoded string). A null
    list gives an empty text."""
    check_names(id_col, ("ids", "decoded"))
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocab_path))
    rows = df.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            for part in _parts(batch, 200):
                ids = pa.concat_arrays([part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), ids, vocab.decode(ids).cast(pa.string())], [id_col, "ids", "decoded"])

    schema = T.StructType([*rows.schema.fields[:1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema)
