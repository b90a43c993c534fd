"""Timeline bins over a stream of events: the same sums as in a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def streamed_bins(events: DataFrame, time: str, width: str, late: str, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, start, n, sums) for tumbling windows of a width; rows later than
    ``late`` behind the newest time are left out of a stream, none of a batch."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    per = rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return per.select(*keys, F.col("window.start").alias("start"), "n", *sums)


def _behind(time: str, mark: Column, late: str) -> Column:
    return F.coalesce(F.col(time) < mark - F.expr(f"INTERVAL {late}"), F.lit(False))


def store_bins(events: DataFrame, path: str, time: str, width: str, late: str, keys: list[str], sums: dict[str, Column]) -> DataStreamWriter:
    """A writer that keeps a stream's bins below path: the sums of each
    micro-batch, and aside the whole rows that came more than ``late`` behind the
    newest time of the micro-batches before. Start it with a trigger.

    A micro-batch is named by its number and written whole; its mark, the newest
    time so far, comes last. One that is run again, after a failure or a restart from
    the checkpoint in path, writes the same files again, so nothing counts twice."""

    def keep(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        mark = spark.read.parquet(f"{path}/marks/batch={batch - 1}").first()[0] if batch else None
        told = rows.withColumn("__late", _behind(time, F.lit(mark).cast("timestamp"), late))
        told.where("__late").drop("__late").write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        per = told.groupBy("__late", F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
        per.select(F.col("__late").alias("late"), *keys, F.col("w.start").alias("start"), "n", *sums).write.mode("overwrite").parquet(f"{path}/bins/batch={batch}")
        newest = rows.agg(F.greatest(F.max(F.col(time).cast("timestamp")), F.lit(mark).cast("timestamp")).alias("newest"))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")


def _marked(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of the micro-batches that were written whole."""
    done = spark.read.parquet(f"{path}/marks").select("batch").distinct()
    return spark.read.parquet(f"{path}/{table}").join(F.broadcast(done), "batch")  # a number for each micro-batch


def stored_bins(spark: SparkSession, path: str, keys: list[str], sums: Sequence[str], late: bool = False) -> DataFrame:
    """(keys, start, n, sums) of the bins that store_bins keeps; with late, the
    rows put aside count too, which gives what a batch over all rows gives."""
    rows = _marked(spark, path, "bins")
    rows = rows if late else rows.where("NOT late")
    return rows.groupBy(*keys, "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The whole rows put aside, with the micro-batch that they came in."""
    return _marked(spark, path, "late")
