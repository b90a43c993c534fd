"""Corpus pipeline: quality rules, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import language, packing, quality, secrets, simhash
from stackloom.llm.common import materialize

#: Least score with which a document's language counts as told.
MIN_LANGUAGE_SCORE = 0.2


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with columns of other names, so that none clashes with a result's,
    and the name of the text."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the default policy."""
    rows, text = _numbered(docs)
    good = quality.measure(rows, text_col=text, keep=True).where(~quality.failed())
    return good.select(*rows.columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    rows, text = _numbered(docs)
    told = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    good = language.predict(rows, language.fit(docs), text_col=text, keep=True).where(told)
    return good.select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash candidates from
    BK-trees, verified as five-word shingles of Jaccard similarity 0.8 or more."""
    rows, text = _numbered(docs)
    ids = rows.columns[docs.columns.index("doc_id")]
    return simhash.drop_near_duplicates(rows, id_col=ids, text_col=text).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars to match. Ids may be null or
    repeat, so findings go by text and path."""
    rows, text = _numbered(docs)
    path = rows.columns[docs.columns.index("source")]
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col(path).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    keyed = rows.withColumn("key", key)
    clean = secrets.redact(keyed, secrets.scan(keyed, id_col="key", text_col=text, path_col=path), id_col="key", text_col=text)
    columns = [F.length(text).cast("long").alias(c) if name == "n_chars" else F.col(c) for c, name in zip(rows.columns, docs.columns, strict=True)]
    return clean.select(*columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL expresses none of the stages but the first.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
