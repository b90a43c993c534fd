"""The corpus operators, each applied to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, conversations, language, licenses, neighbours, packing, pages, quality, secrets, simhash, surrogates, toxicity
from .common import held_out, table

WORD_BPE = "word_bpe_49k.json"
#: Of the registered query only; users pass a secret of their own.
PII_KEY = "query"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    got = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), path_col="source")
    return found.select("doc_id", "k", "start", "value", "score", "is_secret")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels, "toxic"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst_sentence", "worst_score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.surrogate(docs, PII_KEY)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarize(licenses.scan(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = language.predict(docs, language.fit(docs.where(~held_out())))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.apply_policy(quality.measure(table(spark, sf_dir, "documents")))
    return ledger.select("doc_id", *quality.MEASURES, "failed_bits", quality.failed(quality.BASE).alias("base_failed"), "kept")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy costs, from the ledger's bits."""
    return quality.ablations(quality.measure(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_secrets, op3_toxicity, op4_pii, op5_packing, op6_simhash, op7_licenses, op8_language, op9_neighbours, op10_quality, op11_conversations, op12_pages, op13_centroids, quality_ablations)}

#: DuckDB SQL for the queries that it can express.
ORACLE_SQL: dict[str, str] = {
    "op10_quality": quality.ledger_sql() + f"SELECT doc_id, {', '.join(quality.MEASURES)}, failed_bits, base_failed, kept FROM ledger",
    "op11_conversations": conversations.repair_sql(),
    "op13_centroids": centroids.cluster_sql(),
    "quality_ablations": quality.ablations_sql(),
}
