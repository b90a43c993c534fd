"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams of 1 to MAX_N letters that both
hold, over the square root of the product of how many each holds (a blended
spectrum of presences), counted over the n-grams that landmarks hold. A text
longer than a segment counts as the mean of its segments, all of them, so that
the kernel of a text doesn't fade as it grows and meets ever more n-grams.
Landmark segments, drawn for each language, give a Nyström map into an explicit
space; one ridge regression for each language is fitted there against the
others. Texts are scored in batches by products of matrices: presences times
landmarks times the map times the weights, the last three multiplied beforehand.

N-grams are kept as they are, none stands for another. Learning uses at most
``sample`` labelled rows of each language (fewer where ROWS / languages is less),
the first by a hash of the id, with their whole texts; a row's kernels with the
landmarks are worked out where the row is, and only these reach the driver. A
landmark is one segment of a row, drawn by that hash. Presences are sparse
everywhere: a landmark holds at most MAX_N n-grams for each symbol of its segment,
so that a model's size follows the landmarks, whose number is bounded, and not
languages times n-grams. Languages may be any number. Prediction covers all
rows and whole texts. A text that is null or has no letter is UNDETERMINED with
score 0. Without labelled rows every text is UNDETERMINED. Of languages that
score the same, the first in order is taken. Repeated rows have a row of the
result each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_names, materialize, sample_keys

UNDETERMINED = "und"
MAX_N = 3
#: Letters and gaps of a segment, about.
SEGMENT = 2_048
#: Labelled rows of a language that a model is learned from at most, and of all together (but one for each language).
SAMPLE, ROWS = 300, 20_000
#: Landmarks of a language at most, and of all together (but one for each language).
LANDMARKS, ALL_LANDMARKS = 40, 1_024
RIDGE = 0.01
#: Largest table that n-grams are looked up in by place; n-grams x languages up to which their weights are added beforehand.
_TABLE, _FOLD = 1 << 22, 1 << 23
#: Marks of segments, sums of kernels and characters that are worked on at a time.
_BLOCK, _SUMS, _CHARS = 1 << 22, 1 << 21, 1 << 20
_LETTER = regex.compile(r"\p{L}")


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased letters of all texts as code points, a space for each run
    of anything else, and the number of each one's text."""
    joined = "\0".join((t or "").replace("\0", " ").lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = np.zeros(int(codes.max(initial=0)) + 1, bool)
    letter[codes] = True
    for c in np.flatnonzero(letter).tolist():
        letter[c] = chr(c).isalpha()
    row = np.cumsum(codes == 0)
    is_letter = letter[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep &= codes != 0
    return np.where(is_letter, codes, 32)[keep], row[keep]


def segments(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each symbol, and the text of each segment: each text of n
    is cut in equal parts."""
    size = np.bincount(row, minlength=n)
    parts = np.maximum(1, np.round(size / SEGMENT).astype(np.int64))
    first = np.cumsum(parts) - parts
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return first[row] + place * parts[row] // np.maximum(size[row], 1), np.repeat(np.arange(n), parts)


def grams(symbol: np.ndarray, segment: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, segments) for n from 1 to MAX_N; 21 bits for each symbol."""
    gram = np.zeros(len(symbol), np.int64)
    for n in range(1, MAX_N + 1):
        m = len(symbol) - n + 1
        if m <= 0:
            return
        gram = gram[:m] << 21 | symbol[n - 1 :]
        inside = segment[:m] == segment[n - 1 :]
        yield gram[inside], segment[:m][inside]


class Index:
    """Numbers of the n-grams that landmarks hold."""

    def __init__(self, known: np.ndarray):
        self.known = known  # ascending
        parts = np.concatenate([known >> 42, known >> 21 & (1 << 21) - 1, known & (1 << 21) - 1])
        self.letters = np.unique(np.append(parts, 0))  # 0 stands before n-grams of fewer than MAX_N
        self.base = len(self.letters) + 1  # the last number is that of any other letter
        self.of_letter = np.full(int(self.letters.max()) + 2, self.base - 1, np.int64)
        self.of_letter[self.letters] = np.arange(len(self.letters))
        self.table = None
        if self.base**MAX_N <= _TABLE:
            self.table = np.full(self.base**MAX_N, -1, np.int32)
            a, b, c = (self.of_letter[p] for p in np.split(parts, 3))
            self.table[(a * self.base + b) * self.base + c] = np.arange(len(known))

    def presences(self, symbol: np.ndarray, segment: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(segments, n-grams) that hold each other, ascending, each pair once."""
        held = np.zeros(n * len(self.known), np.uint8)
        if self.table is None:
            for gram, of in grams(symbol, segment):
                at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
                hit = self.known[at] == gram
                held[of[hit] * len(self.known) + at[hit]] = 1
        else:
            letter = self.of_letter[np.minimum(symbol, len(self.of_letter) - 1)]
            key = np.zeros(len(symbol), np.int64)
            for k in range(1, MAX_N + 1):
                m = len(symbol) - k + 1
                if m <= 0:
                    break
                key = key[:m] * self.base + letter[k - 1 :]
                at = self.table[key]
                hit = (at >= 0) & (segment[:m] == segment[k - 1 :])
                held[segment[:m][hit] * len(self.known) + at[hit]] = 1
        return np.divmod(np.flatnonzero(held), len(self.known))

    def means(self, texts: list[str | None], times, width: int) -> np.ndarray:
        """The mean over each text's segments of presences, over the square root
        of how many a segment holds, times a matrix of this width: ``times``
        gives the products of some segments' presences."""
        symbol, row = symbols(texts)
        segment, text = segments(row, len(texts))
        out = np.zeros((len(texts), width))
        step = min(256, max(1, _BLOCK // len(self.known)))
        ends = np.searchsorted(segment, np.arange(len(text) + 1))
        for at in range(0, len(text), step):
            to = min(at + step, len(text))
            part = slice(ends[at], ends[to])
            of, gram = self.presences(symbol[part], segment[part] - at, to - at)
            size = np.sqrt(np.maximum(np.bincount(of, minlength=to - at), 1))
            np.add.at(out, text[at:to], times(of, gram, to - at) / size[:, None])
        return out / np.bincount(text, minlength=len(texts))[:, None]


class Marks:
    """Landmarks: for each n-gram those that hold it."""

    def __init__(self, texts: list[str]):
        symbol, row = symbols(texts)
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in grams(symbol, row))]))
        self.n = len(texts)
        if not len(self.known):
            return
        index, ends = Index(self.known), np.searchsorted(row, np.arange(self.n + 1))
        held = [index.presences(symbol[ends[i] : ends[i + 1]], row[ends[i] : ends[i + 1]] - i, 1)[1] for i in range(self.n)]
        mark = np.repeat(np.arange(self.n, dtype=np.int32), [len(h) for h in held])
        gram = np.concatenate(held)
        order = np.argsort(gram, kind="stable")
        self.mark, self.start = mark[order], np.searchsorted(gram[order], np.arange(len(self.known) + 1))
        self.value = (1 / np.sqrt(np.maximum([len(h) for h in held], 1)))[self.mark].astype(np.float32)

    def kernels(self, of: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """Segments' presences times landmarks, some n-grams at a time."""
        out = np.zeros(n * self.n)
        first, many = self.start[gram], np.diff(self.start)[gram]
        sums = np.cumsum(many)
        at = 0
        while at < len(gram):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _SUMS, "right")))
            k = many[at:to]
            place = np.repeat(first[at:to] - np.cumsum(k) + k, k) + np.arange(k.sum())
            out += np.bincount(np.repeat(of[at:to] * self.n, k) + self.mark[place], weights=self.value[place], minlength=len(out))
            at = to
        return out.reshape(n, self.n)

    def nystroem(self) -> np.ndarray:
        """The map from kernels with the landmarks to the explicit space."""
        each, gram = self.mark, np.repeat(np.arange(len(self.known)), np.diff(self.start))
        order = np.argsort(each, kind="stable")
        each, gram = each[order], gram[order]
        ends = np.searchsorted(each, np.arange(self.n + 1))
        size = np.sqrt(np.maximum(np.diff(ends), 1))
        square = np.concatenate([self.kernels(np.zeros(ends[i + 1] - ends[i], np.int64), gram[ends[i] : ends[i + 1]], 1) for i in range(self.n)]) / size[:, None]
        value, vector = np.linalg.eigh((square + square.T) / 2)
        good = value > 1e-6 * value.max()
        return vector[:, good] / np.sqrt(value[good])

    def times(self, weights: np.ndarray) -> np.ndarray:
        """n-grams x landmarks times landmarks x languages."""
        gram = np.repeat(np.arange(len(self.known)), np.diff(self.start))
        return np.stack([np.bincount(gram, self.value * w[self.mark], len(self.known)) for w in weights.T], 1)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    marks: Marks | None
    weights: np.ndarray  # landmarks x languages: the Nyström map times the regressions

    def scorer(self):
        if self.languages:
            index, width = Index(self.marks.known), len(self.languages)
            if len(index.known) * width <= _FOLD:
                folded = self.marks.times(self.weights)

                def times(of: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
                    return np.stack([np.bincount(of, folded[gram, k], n) for k in range(width)], 1)
            else:

                def times(of: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
                    return self.marks.kernels(of, gram, n) @ self.weights

        def score(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if not self.languages:
                return names, scores
            each = index.means(texts, times, width)
            for i, (k, text) in enumerate(zip(each.argmax(1).tolist(), texts, strict=True)):
                if text and _LETTER.search(text):
                    names[i], scores[i] = self.languages[k], min(1.0, max(0.0, float(each[i, k])))
            return names, scores

        return score


def blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of these sizes: 256 at most, and _CHARS unless one is longer."""
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and (i - at == 256 or total + size > _CHARS):
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def drawn_segment(text: str, draw: int) -> str:
    """One segment's letters and gaps."""
    symbol, row = symbols([text])
    segment, parts = segments(row, 1)
    return "".join(map(chr, symbol[segment == draw % len(parts)].tolist()))


def kernels(texts: list[str], marks: Marks) -> np.ndarray:
    """Kernels of whole texts with the landmarks."""
    index = Index(marks.known)
    return np.concatenate([np.zeros((0, marks.n)), *(index.means(texts[at:to], marks.kernels, marks.n) for at, to in blocks([len(t) for t in texts]))])


def regress(near: np.ndarray, langs: list[str], marks: Marks, ridge: float = RIDGE) -> Model:
    """One ridge regression for each language against the others, from kernels with the landmarks."""
    languages = tuple(sorted(set(langs)))
    y = (np.array(langs, object)[:, None] == np.array(languages, object)[None, :]).astype(float)
    nystroem = marks.nystroem()
    z = near @ nystroem
    weight = (1 / y.sum(0)) @ y.T  # every language counts alike
    a = z.T @ (z * weight[:, None])
    beta = np.linalg.solve(a + ridge * np.eye(len(a)) * len(languages) / len(a), z.T @ (y * weight[:, None]))
    return Model(languages, marks, nystroem @ beta)


NOTHING = Model((), None, np.zeros((0, 0)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from at most ``sample`` rows of each language, of which at most
    ``landmarks`` give a landmark. The driver gets the landmarks and the rows'
    kernels with them (ROWS x ALL_LANDMARKS at most, but for one row and one landmark of each language)."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    languages = max(1, rows.select("lang").distinct().count())
    keys = sample_keys(rows.select("i", "lang"), "i", max(1, min(sample, ROWS // languages)), "lang")
    keys = keys.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    # at most ROWS ids, or one for each language; rows with one id count once
    got = rows.join(F.broadcast(keys.select("i", "lang", "h", "k")), ["i", "lang"]).groupBy("lang", "h", "k").agg(F.min("text").alias("text"))
    got = materialize(got, "learned")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["lang", "h"]].assign(segment=[drawn_segment(t, h) for t, h in zip(batch["text"], batch["h"], strict=True)])

    each = max(1, min(landmarks, ALL_LANDMARKS // languages))
    chosen = got.where(F.col("k") <= each).mapInPandas(draw, T.StructType([got.schema["lang"], got.schema["h"], T.StructField("segment", T.StringType())])).toPandas()
    marks = Marks(chosen.sort_values(["lang", "h"], kind="stable")["segment"].tolist())
    if not len(marks.known):
        return NOTHING
    shared = df.sparkSession.sparkContext.broadcast(marks)  # n-grams of a bounded number of segments

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = kernels(batch["text"].tolist(), shared.value).astype(np.float32)
            yield batch[["lang", "h"]].assign(near=[x.tobytes() for x in found])

    all_near = got.mapInPandas(near, T.StructType([got.schema["lang"], got.schema["h"], T.StructField("near", T.BinaryType())])).toPandas().sort_values(["h", "lang"], kind="stable")
    return regress(np.stack([np.frombuffer(x, np.float32) for x in all_near["near"]]).astype(np.float64), all_near["lang"].tolist(), marks, ridge)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, lang_pred string, score double). With keep, all columns of df stand
    in place of the id."""
    kept = df.columns if keep else [id_col]
    for c in kept:
        check_names(c, ("lang_pred", "score"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # n-grams of a bounded sample
    rows = df.select(*kept) if keep else df.select(F.col(id_col), F.col(text_col).alias("__text"))
    at = kept.index(text_col) if keep else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            for i, to in blocks(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()):
                part = batch.slice(i, to - i)
                names, scores = score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
