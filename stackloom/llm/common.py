"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id as text) modulo 4 that is never learned from.
HELD_OUT_FOLD = 2
#: Bits for each key of a Bloom filter, and its words of 64 bits at most.
FILTER_BITS, FILTER_WORDS = 16, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for rows of the held-out fold; a null id is never held out."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string")) % 4 == HELD_OUT_FOLD, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A
    local session, as in tests, gets a temporary one where it names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stackloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at}/stackloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage
    cut, and still there when an executor is lost. ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete all tables that this application has stored in the shared folder
    (raw mentions and candidates among them). Results that haven't been written
    can't be read any more afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def marked_as_near(df: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """df with a column mark: true where keys may hold the key, false only where
    it does not. What is false needn't be shuffled for a join with keys. That is a
    Bloom filter of FILTER_BITS bits for each key in FILTER_WORDS words at most,
    which are broadcast; with more keys it is true more often."""
    words = min(FILTER_WORDS, keys.count() * FILTER_BITS // 64 + 1)
    word, bits = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(words)), F.xxhash64(key, F.lit(8))
    mask = F.lit(0).cast("long")
    for i in range(0, 24, 6):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, i).bitwiseAND(F.lit(63)).cast("int")))
    held = keys.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__held"))
    both = df.withColumns({"__word": word, "__mask": mask}).join(F.broadcast(held), "__word", "left")
    return both.withColumn(mark, F.coalesce(F.col("__held").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))).drop("__word", "__mask", "__held")


def check_names(id_col: str, outputs: tuple[str, ...]) -> None:
    """Operators return the id column and columns of their own; they refuse an
    id column that bears one of these names."""
    if id_col in outputs:
        raise ValueError(f"the id column {id_col!r} clashes with a result column")


def sample_keys(df: DataFrame, id_col: str, size: int, by: str | None = None) -> DataFrame:
    """At most ``size`` rows of df (of each value of by), the first by a hash h
    of the id, which is added; of rows with the same hash and value one stays.
    The hash is cut at a bound that holds about twice as many, so that nothing
    large is sorted."""
    group = F.col(by) if by else F.lit(1)
    rows = df.withColumn("h", F.xxhash64(id_col)).withColumn("__group", group)
    # stored, so that its size is known: a few groups are broadcast, and rows aren't dealt by theirs
    stats = materialize(rows.groupBy("__group").agg(F.count("*").alias("__n"), F.min("h").alias("__low")), "groups")
    below = F.lit(-(2.0**63)) + F.lit(2.0**64) * 2 * size / F.col("__n")
    near = rows.join(stats, "__group").where((F.col("__n") <= 4 * size) | (F.col("h") < below) | (F.col("h") == F.col("__low")))
    order = Window.partitionBy("__group").orderBy("h")
    near = near.dropDuplicates(["__group", "h"]).withColumn("__k", F.row_number().over(order))
    return near.where(F.col("__k") <= size).drop("__k", "__n", "__low", "__group")
