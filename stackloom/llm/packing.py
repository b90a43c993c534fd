"""Best-fit packing of token pieces by sums of squares.

Every document is tokenized, closed by a separator, and cut only where it is
longer than a sequence. Pieces are dealt by hash to shards whose number grows
with the table, so that no key can make one shard large. In a shard, pieces are
taken from the longest to the shortest; each goes to the open bin (or to a new
one) that makes the sum over all gaps of the squared number of open bins with
that gap the smallest, which keeps bins of every gap at hand and so fills them.
When a shard's pieces are all placed, nothing more can come for the bins that
are still open: their pieces are taken out and placed once more, each where the
smallest gap is left.

Null text counts as empty: one piece that holds the separator alone. Rows with
the same id are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, read_vocabulary, vocabulary
from .common import check_names, materialize

#: Pieces that a shard holds on average; the larger, the fewer bins stay open.
SHARD_PIECES = 60_000


class SquaresPacker:
    """Bins of one size, filled so that the squared counts of open bins per gap
    stay small. Ties go to the smallest gap, and to a new bin last."""

    def __init__(self, size: int):
        self.size = size
        self.open = np.zeros(size, np.int64)  # open bins by gap; none at gap 0
        self.bins: list[list[int]] = [[] for _ in range(size)]
        self.used: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece; 0 < length <= size."""
        size, n = self.size, self.open
        if length == size:
            self.used.append(size)
            return len(self.used) - 1, 0
        old = n[length:]
        # by what the sum grows: 2 (n[gap - length] - n[gap]) + 2, one less where the bin is filled up
        grown = np.where(old > 0, 2 * (n[: size - length] - old) + 2, np.iinfo(np.int64).max)
        grown[0] -= old[0] > 0
        best = int(grown.argmin())
        if grown[best] < 2 * n[size - length] + 1:
            gap = best + length
            at = self.bins[gap].pop()
            n[gap] -= 1
        else:
            gap = size
            at = len(self.used)
            self.used.append(0)
        offset = self.used[at]
        self.used[at] += length
        if gap > length:
            n[gap - length] += 1
            self.bins[gap - length].append(at)
        return at, offset


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths are taken in the given order."""
    packer = SquaresPacker(size)
    placed = np.array([packer.place(n) for n in lengths.tolist()], np.int64).reshape(-1, 2)
    bins, offsets = placed[:, 0], placed[:, 1]
    used = np.array(packer.used, np.int64)
    again = np.flatnonzero(used[bins] < size)
    free = np.flatnonzero(used < size).tolist()[::-1]
    last: list[list[int]] = [[] for _ in range(size + 1)]  # re-opened bins by gap
    count = np.zeros(size + 1, np.int64)
    for i in again[np.argsort(-lengths[again], kind="stable")].tolist():
        n = int(lengths[i])
        fits = np.flatnonzero(count[n:])
        if len(fits):
            gap = int(fits[0]) + n
            at = last[gap].pop()
            count[gap] -= 1
        else:
            # best fit needs no more bins than before in practice; one more is numbered after all others
            gap, at = size, free.pop() if free else len(used)
            if at == len(used):
                used = np.append(used, 0)
        bins[i], offsets[i] = at, size - gap
        last[gap - n].append(at)
        count[gap - n] += 1
    return bins, offsets


def token_pieces(df: DataFrame, vocab_path: str, max_tokens: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most max_tokens ids, separator included: (id, piece int,
    start long, length long, ids_crc32 long)."""
    check_names(id_col, ("piece", "start", "length", "ids_crc32"))
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocab_path))  # a file of fixed size
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None

        def pairs() -> Iterator[tuple[object, str | None]]:
            nonlocal at
            for batch in batches:
                at = batch.schema.field(0).type
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

        for keys, flat, counts in Encoder(vocabulary(shared.value)).blocks(pairs()):
            ends = np.cumsum(counts)
            ids = np.insert(flat, ends, separator).astype("<u4")
            ends = ends + np.arange(1, len(keys) + 1)
            raw = memoryview(ids.tobytes())
            out: list[list] = [[], [], [], [], []]
            for key, end, n in zip(keys, ends.tolist(), (counts + 1).tolist(), strict=True):
                for k, start in enumerate(range(0, n, max_tokens)):
                    length, first = min(max_tokens, n - start), end - n + start
                    for column, x in zip(out, (key, k, start, length, zlib.crc32(raw[4 * first : 4 * (first + length)])), strict=True):
                        column.append(x)
            kinds = [at, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, max_tokens: int = 2048, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id long and offset long to pieces (id, piece, length and
    any other columns but these two)."""
    check_names(id_col, ("sequence_id", "offset"))
    rows = materialize(pieces.drop("sequence_id", "offset"), "pieces")  # counted and packed, tokenized once
    shards = max(1, -(-rows.count() // shard_pieces))
    # the written table is read in the same splits by every try of a task, so a row's number stays
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = rows.columns

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable", na_position="last")
        bins, offsets = pack_lengths(group["length"].to_numpy(np.int64), max_tokens)
        return group[names].assign(sequence_id=(int(group["__shard"].iloc[0]) << 32) + bins, offset=offsets)

    return rows.withColumn("__shard", key).groupBy("__shard").applyInPandas(fill, schema)


def pack_documents(df: DataFrame, vocab_path: str, max_tokens: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Tokenize, cut and pack: (id, piece, start, length, ids_crc32,
    sequence_id, offset)."""
    return pack(token_pieces(df, vocab_path, max_tokens, separator, id_col, text_col), max_tokens, shard_pieces, id_col)


def sequences(packed: DataFrame, ids: DataFrame, max_tokens: int = 2048, separator: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<int>). ids is
    what bpe.encode() returns; it must hold each id once."""
    closed = ids.select(id_col, F.concat("ids", F.array(F.lit(separator))).alias("__ids"))
    parts = packed.join(closed, id_col).select("sequence_id", "offset", F.slice("__ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("__ids"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "__ids"))), lambda x: x["__ids"])).alias("ids"))
