"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores sigmoid(b + sum of the
weights of its distinct chunks between spaces); a chunk's weight is that of the
words in it and of their beginnings, which inflected forms share. The document is toxic if any sentence is, so
its score is the noisy-or 1 - (1 - sigmoid(b)) * prod(1 - sentence score) over
the sentences with any weight; the others leak once, not once each. Weights are learned
from document labels alone, by gradient descent on the document's likelihood,
and then say which sentences offend.

Learning uses at most ``sample`` labelled rows, the first by a hash of the id
whose texts together have at most ``chars`` characters; scoring runs over all
rows and whole texts. Words and beginnings whose share of toxic documents
differs from that of all by fewer than MIN_Z standard deviations get no weight, so the
model is a small table. Null and empty texts have one empty sentence
and score sigmoid(b). Null labels are not learned from; a table without labels
gives a model that scores PRIOR everywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_names, sample_keys

#: Labelled rows that a model is learned from at most, and characters of their texts together.
SAMPLE, SAMPLE_CHARS = 4_000, 64_000_000
#: Standard deviations by which a word must stand out.
MIN_Z = 4.5
#: Smaller weights are left out.
MIN_WEIGHT = 0.1
#: Lengths of the beginnings of words that have weights.
STEMS = (4, 5, 6, 7)
PRIOR = 0.05
#: a run of marks is looked at once, from its beginning, so that long ones stay cheap
_SENTENCE = re.compile(r"(?<![.!?])[.!?]+(?=\s|$)|\n+")
_WORD = re.compile(r"\w+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; at least one, which may be empty."""
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()] or [""]


def features(chunk: str) -> list[str]:
    """The words in a chunk between spaces, lower-cased, and their beginnings."""
    chunk = chunk.lower()
    words = (chunk,) if chunk.isalpha() else _WORD.findall(chunk)
    return [f for w in words for f in (w, *[w[:n] + "*" for n in STEMS if len(w) >= n])]


def _features_of(text: str | None) -> set[str]:
    return {f for chunk in set((text or "").split()) for f in features(chunk)}


class _Memo(dict):
    """What a function gives for each chunk, worked out when first asked for."""

    def __init__(self, of: Callable[[str], object], size: int = 400_000):
        self.of, self.size = of, size

    def __missing__(self, chunk: str) -> object:
        if len(self) > self.size:
            self.clear()
        self[chunk] = x = self.of(chunk)
        return x


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self) -> Callable[[str | None], np.ndarray]:
        """A function that gives the scores of a text's sentences."""
        get = self.weights.get
        starts = {f[:3] for f in self.weights}

        def weight(chunk: str) -> float:
            # most chunks are one word, and begin as no feature does
            if chunk[:3].lower() not in starts and (chunk.isalpha() or chunk[:-1].isalpha()):
                return 0.0
            return sum([get(f, 0.0) for f in features(chunk)])

        memo = _Memo(weight)

        def score_sentences(text: str | None) -> np.ndarray:
            split = sentences(text)
            z = np.full(len(split), self.bias)
            known = {c: x for c in set((text or "").split()) if (x := memo[c])}
            if known:
                for i, s in enumerate(split):
                    # the mark that ends a sentence is not part of it, but of the text's chunk
                    z[i] += sum([memo[c] for c in sorted(set(s.split()))])
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score_sentences


def noisy_or(each: np.ndarray, bias: float) -> float:
    """Score of a document from those of its sentences."""
    leak = 1 / (1 + np.exp(-bias))
    some = np.minimum(each[np.abs(each - leak) > 1e-15], 1 - 1e-12)
    return float(-np.expm1(np.log1p(-some).sum() + np.log1p(-leak)))


def learn(rows: pd.DataFrame, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """Fit to texts and 0/1 labels in columns text and label, by Adam."""
    y = rows["label"].to_numpy(float) if len(rows) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model({}, float(np.log(PRIOR / (1 - PRIOR))))
    # most features stand in one or two texts; a table of hashes tells which can't reach three, and is exact above
    rough = np.zeros(1 << 22, np.int32)
    for text in rows["text"]:
        rough[np.unique([crc32(f.encode("utf-8", "surrogatepass")) & (1 << 22) - 1 for f in _features_of(text)]).astype(np.int64)] += 1
    often = (rough >= 3).tobytes()
    seen, toxic = Counter(), Counter()
    for text, label in zip(rows["text"], y.tolist(), strict=True):
        got = [f for f in _features_of(text) if often[crc32(f.encode("utf-8", "surrogatepass")) & (1 << 22) - 1]]
        seen.update(got)
        if label:
            toxic.update(got)
    p = y.mean()
    words = sorted(w for w, n in seen.items() if n >= 3 and abs(toxic[w] - n * p) >= MIN_Z * (n * p * (1 - p)) ** 0.5)
    number = {w: i for i, w in enumerate(words)}
    del seen, toxic
    memo = _Memo(lambda chunk: [number[f] for f in features(chunk) if f in number], 100_000)
    # each document: its sentences with features, and one without, the leak
    kept = [[[], *(f for s in sentences(text) if (f := [i for c in sorted(set(s.split())) for i in memo[c]]))] for text in rows["text"]]
    counts = np.array([len(bag) for bag in kept])
    found = [f for bag in kept for f in bag]
    sentence = np.repeat(np.arange(len(found)), [len(f) for f in found])
    flat = np.array([i for f in found for i in f], np.int64)
    doc_of, starts = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    w, b = np.zeros(len(words)), -6.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(sentence, w[flat], len(found)) + b
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        prob = np.clip(-np.expm1(np.add.reduceat(np.log1p(-np.minimum(q, 1 - 1e-12)), starts)), 1e-9, 1 - 1e-9)
        # d loss / d z is q for a clean document, -q (1 - prob) / prob for a toxic one
        gz = q * np.where(y > 0, -(1 - prob) / prob, 1.0)[doc_of] / len(y)
        g = np.append(np.bincount(flat, gz[sentence], len(words)) + l2 * w, gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model({f: x for f, x in zip(words, w.tolist(), strict=True) if abs(x) >= MIN_WEIGHT}, float(b))


def fit(df: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from the texts of df for at most ``sample`` ids of labels whose
    label isn't null. Of rows with one id, the greatest label and the smallest text count."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    keys = sample_keys(known, "i", sample).select("i", "label", "h")
    texts = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
    # at most sample ids and lengths come first, to see which texts may
    sizes = texts.join(F.broadcast(keys), "i").groupBy("i", "label", "h").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n")).toPandas().sort_values("h", kind="stable")
    # a text that doesn't fit any more is passed over, those after it aren't
    used, take = 0, []
    for n in sizes["n"].tolist():
        take.append(used + n <= chars)
        used += n if take[-1] else 0
    fits = sizes[take]
    if not len(fits):
        return learn(pd.DataFrame({"text": [], "label": []}))
    schema = T.StructType([T.StructField("i", df.schema[id_col].dataType), T.StructField("label", T.IntegerType())])
    chosen = df.sparkSession.createDataFrame(list(zip(fits["i"].tolist(), fits["label"].tolist(), strict=True)), schema)
    got = texts.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("text").alias("text"), F.max("label").alias("label")).toPandas()
    return learn(got.sort_values("i", kind="stable"))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, worst_sentence int, worst_score double): the noisy-or
    of every whole text, and the sentence, from 0, that scores highest."""
    check_names(id_col, ("score", "worst_sentence", "worst_score"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # words of a bounded sample
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_sentences = shared.value.scorer()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                each = [score_sentences(t) for t in part.column(1).to_pylist()]
                out = [pa.array([noisy_or(e, shared.value.bias) for e in each], pa.float64()), pa.array([int(e.argmax()) for e in each], pa.int32()), pa.array([float(e.max()) for e in each], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], [id_col, "score", "worst_sentence", "worst_score"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("worst_sentence", T.IntegerType()), T.StructField("worst_score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def offending_sentences(df: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence int, sentence_text string, sentence_score double) for all
    sentences that score at least the threshold."""
    check_names(id_col, ("sentence", "sentence_text", "sentence_score"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_sentences = shared.value.scorer()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows, place, found, value = [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    each = score_sentences(text)
                    for k in np.flatnonzero(each >= threshold).tolist():
                        for column, x in zip((rows, place, found, value), (row, k, sentences(text)[k], float(each[k])), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(place, pa.int32()), pa.array(found, pa.string()), pa.array(value, pa.float64())], [id_col, "sentence", "sentence_text", "sentence_score"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("sentence", T.IntegerType()), T.StructField("sentence_text", T.StringType()), T.StructField("sentence_score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
