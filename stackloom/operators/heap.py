"""Heap traces: matching allocations with releases, and the running heap size.

Event types: 0 allocation, 1 release, 2 reallocation, 3 map, 4 unmap. All
windows are by run and address, or by run; rows are ordered by time and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.operators.ranges import running

MALLOC, FREE, REALLOC, MMAP, MUNMAP = range(5)


def leak_match(heap: DataFrame) -> DataFrame:
    """heap with hleaked and link_row: an allocation that the next event at its
    address releases has leaked 0 and links to that row's number plus one; the
    others have leaked their size. A reallocation takes its new address before
    it gives up the old one, so one in place releases itself."""
    heap = heap.drop("hleaked", "link_row")
    takes, gives = F.col("htype").isin(MALLOC, MMAP, REALLOC), F.col("htype").isin(FREE, MUNMAP)
    touch = lambda addr, seq, release: F.struct(addr.alias("addr"), F.lit(seq).alias("seq"), F.lit(release).alias("release"))
    none = F.lit(None).cast("struct<addr:bigint,seq:int,release:boolean>")
    touches = F.array(
        F.when(takes, touch(F.col("hvaddr"), 0, False)).when(gives, touch(F.col("hvaddr"), 0, True)).otherwise(none),
        F.when(F.col("htype") == REALLOC, touch(F.col("hovaddr"), 1, True)).otherwise(none),
    )
    rows = heap.select("exp_id", "row_id", "tstamp", F.inline(F.filter(touches, lambda t: t.isNotNull()))).where("addr <> 0")
    at = Window.partitionBy("exp_id", "addr").orderBy("tstamp", "row_id", "seq")
    nexts = rows.withColumn("__next", F.lead(F.struct("row_id", "release")).over(at)).where(~F.col("release") & F.col("__next.release"))
    matched = nexts.select("exp_id", "row_id", (F.col("__next.row_id") + 1).alias("link_row"))
    out = heap.join(matched, ["exp_id", "row_id"], "left")
    leaked = F.when(takes & F.col("link_row").isNull(), F.col("hsize")).otherwise(F.lit(0).cast("bigint"))
    return out.withColumn("hleaked", leaked).withColumn("link_row", F.coalesce("link_row", F.lit(0).cast("bigint"))).select(*heap.columns, "hleaked", "link_row")


def release_rows(matched: DataFrame) -> DataFrame:
    """(exp_id, row_id, release_row, release_tstamp) for released allocations."""
    later = matched.select("exp_id", F.col("row_id").alias("release_row"), F.col("tstamp").alias("release_tstamp"))
    return matched.where("link_row > 0").select("exp_id", "row_id", (F.col("link_row") - 1).alias("release_row")).join(later, ["exp_id", "release_row"]).select("exp_id", "row_id", "release_row", "release_tstamp")


def heap_size(matched: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(exp_id, row_id, tstamp, net_alloc, cur_allocs, cur_leaks) from what
    leak_match() gives. With kept, a filtered view of it, only its rows count,
    but the row that releases one of them counts even if it isn't kept."""
    kept = matched if kept is None else kept
    allocates = F.col("htype").isin(MALLOC, MMAP, REALLOC)
    touch = lambda row, delta, leak, seq: F.struct(row.alias("row"), delta.cast("bigint").alias("delta"), leak.cast("bigint").alias("leak"), F.struct(F.col("row_id").alias("row"), F.lit(seq).alias("seq")).alias("ord"), F.lit(seq).alias("release"))
    own = touch(F.col("row_id"), F.when(allocates, F.col("hsize")).otherwise(0), F.col("hleaked"), 0)
    gone = F.when(F.col("link_row") > 0, touch(F.col("link_row") - 1, -F.col("hsize"), F.lit(None), 1))
    touches = kept.select("exp_id", F.inline(F.filter(F.array(own, gone), lambda t: t.isNotNull()))).withColumnRenamed("row", "row_id")
    touched = touches.groupBy("exp_id", "row_id").agg(
        F.sum("delta").alias("net_alloc"),
        # the leak of a row stands unless a release touches the row after its own touch
        F.when(F.max(F.when(F.col("release") == 1, F.col("ord"))) > F.max(F.when(F.col("release") == 0, F.col("ord"))), 0).otherwise(F.coalesce(F.max("leak"), F.lit(0))).cast("bigint").alias("leak"),
        F.min("ord").alias("ord"),
    )
    rows = touched.join(matched.select("exp_id", "row_id", "tstamp"), ["exp_id", "row_id"])
    sizes = running(rows, ["exp_id"], ["tstamp", "ord"], {"cur_allocs": F.col("net_alloc"), "cur_leaks": F.col("leak")})
    return sizes.select("exp_id", "row_id", "tstamp", "net_alloc", "cur_allocs", "cur_leaks")


def heap_metrics(matched: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, alloc_bytes, allocs, leak_bytes, leaks) over allocations with an
    address."""
    rows = matched.where(~F.col("htype").isin(FREE, MUNMAP) & (F.col("hvaddr") != 0))
    return rows.groupBy(*(keys or [])).agg(F.coalesce(F.sum("hsize"), F.lit(0)).alias("alloc_bytes"), F.count("*").alias("allocs"), F.coalesce(F.sum("hleaked"), F.lit(0)).alias("leak_bytes"), F.count(F.when(F.col("hleaked") != 0, 1)).alias("leaks"))
