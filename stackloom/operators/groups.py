"""Index objects: grouping events by a key expression.

A row without a key is dropped, from the total too. Exclusive and inclusive
values are equal. The total has the key -2.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.expressions import group_handle, shift_left
from stackloom.functions.text import group_label
from stackloom.operators.intervals import THREAD_WIDTH, range_join

TOTAL_KEY = -2
TOTAL_LABEL = "<Total>"


@dataclass
class Groups:
    """Named key expressions; new names must be letters, digits or _, begin
    with a letter or _, and be unused."""

    keys: dict[str, Column] = field(default_factory=dict)
    labels: dict[str, Column | None] = field(default_factory=dict)

    def define(self, name: str, key: Column | str, label: Column | None = None) -> None:
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"not a name: {name!r}")
        if name.lower() in (n.lower() for n in self.keys):
            raise ValueError(f"in use: {name!r}")
        self.keys[name] = F.expr(key) if isinstance(key, str) else key
        self.labels[name] = label

    def label(self, name: str, key: Column) -> Column:
        return self.labels[name] if self.labels[name] is not None else group_label(name, key)


def standard() -> Groups:
    """The built-in ones. They read exp_id, thrid, cpuid, tstamp, start_ns and
    the results of interval lookups, sample and gc."""
    g, key = Groups(), F.col("key")
    g.define("threads", shift_left(F.col("exp_id"), 32).bitwiseOR(F.col("thrid").cast("bigint")), F.format_string("Process %d, Thread %d", F.shiftright(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))))
    g.define("cpus", F.col("cpuid").cast("bigint"), F.format_string("CPU %d", key))
    g.define("samples", F.coalesce(F.col("sample"), F.lit(-1)).cast("bigint"), F.format_string("Sample %s", F.when(key < 0, F.lit("18446744073709551615")).otherwise(key.cast("string"))))
    g.define("gc_events", F.coalesce(F.col("gc"), F.lit(0)).cast("bigint"), F.when(key == 0, "Not in any GCEvent").otherwise(F.format_string("GCEvent %d", key)))
    g.define("seconds", F.call_function("div", F.col("tstamp") - F.col("start_ns"), F.lit(1_000_000_000).cast("bigint")), F.format_string("Second %d", key))
    g.define("processes", F.col("exp_id").cast("bigint"), F.format_string("Process %d", key))
    g.define("experiment_ids", group_handle(F.lit(0), F.col("exp_id")), F.format_string("Experiment 0x%016x", key))
    return g


def index_groups(df: DataFrame, groups: Groups, name: str, sums: dict[str, Column]) -> DataFrame:
    """(key, label, sums): one row for each key, and the total."""
    keyed = df.withColumn("key", groups.keys[name]).where(F.col("key").isNotNull())
    per = keyed.groupBy("key").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])
    total = per.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums]).select(F.lit(TOTAL_KEY).cast("bigint").alias("key"), F.lit(TOTAL_LABEL).alias("label"), *sums)
    return per.select("key", groups.label(name, F.col("key")).alias("label"), *sums).unionByName(total)


def thread_labels(df: DataFrame, jthreads: DataFrame) -> DataFrame:
    """(key, label) of threads: a name known from thread records where one row
    at least has it, else the plain label; the first such row decides."""
    key = shift_left(F.col("exp_id"), 32).bitwiseOR(F.col("thrid").cast("bigint"))
    names = jthreads.select("exp_id", F.col("tid").alias("thrid"), F.col("name").alias("__name"), F.col("start_ns").alias("__from"), F.col("end_ns").alias("__to"), F.col("jthr_id").alias("__j"))
    alive = range_join(df.select("exp_id", "thrid", "row_id", "tstamp"), names, "tstamp", "__from", "__to", THREAD_WIDTH, ("exp_id", "thrid"))
    known = F.concat(F.format_string("Process %d, Thread %d, ", "exp_id", "thrid"), F.lit("JThread "), F.col("__j").cast("string"), F.lit(" '"), F.col("__name"), F.lit("'"))
    named = alive.where(known.isNotNull()).groupBy(key.alias("key")).agg(F.min_by(known, F.struct("row_id", "__j")).alias("__known"))
    plain = df.groupBy(key.alias("key")).agg(F.first(F.format_string("Process %d, Thread %d", "exp_id", "thrid")).alias("label"))
    return plain.join(named, "key", "left").select("key", F.coalesce("__known", "label").alias("label"))


def self_row(grouped: DataFrame, key: int, sums: list[str]) -> DataFrame:
    """The sums of one key, 0 if it is missing."""
    return grouped.where(F.col("key") == key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def summary(table: DataFrame, selected: list, key: str = "function", total: object = "<Total>", excl: str = "excl", incl: str = "incl") -> DataFrame:
    """Sums over selected rows of a table with a total row: inclusive at most
    the total, and shares of the total. The total, if selected, stands for all
    else."""
    chosen = [total] if total in selected else list(selected)
    whole = table.where(F.col(key) == F.lit(total)).agg(F.max(incl).alias("__total"))
    sums = table.where(F.col(key).isin(chosen)).agg(F.coalesce(F.sum(excl), F.lit(0)).alias("__e"), F.coalesce(F.sum(incl), F.lit(0)).alias("__i"))
    one = sums.withColumn("__k", F.lit(1)).join(whole.withColumn("__k", F.lit(1)), "__k")  # one row each
    part = lambda c: F.when(F.col("__total") == 0, 0.0).otherwise(100.0 * c / F.col("__total"))
    capped = F.least("__i", "__total")
    return one.select(F.col("__e").alias("excl"), capped.alias("incl"), part(F.col("__e")).alias("excl_pct"), part(capped).alias("incl_pct"))


def totals_row(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])


def metric_tree(clock: DataFrame, heap: DataFrame, experiments: DataFrame) -> DataFrame:
    """(metric, value): totals of the measures, and duration and collection
    time, in seconds, of the first run."""
    from .heap import heap_metrics
    from .metrics import total_cpu

    cpu = total_cpu(clock).select(F.lit("cpu_sec").alias("metric"), F.col("cpu_sec").alias("value"))
    sizes = heap_metrics(heap).selectExpr("stack(4, 'alloc_bytes', double(alloc_bytes), 'allocs', double(allocs), 'leak_bytes', double(leak_bytes), 'leaks', double(leaks)) as (metric, value)")
    first = experiments.orderBy("exp_id").limit(1).selectExpr("stack(2, 'duration_sec', (last_event_ns - start_ns) / 1e9D, 'gc_sec', gc_duration_ns / 1e9D) as (metric, value)")
    return cpu.unionByName(sizes).unionByName(first)


def entities(kinds: list[DataFrame], column: str) -> DataFrame:
    """Distinct (exp_id, entity) over tables of events, in order."""
    rows = [df.select("exp_id", F.col(column).cast("bigint").alias("entity")) for df in kinds if column in df.columns]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.where("entity IS NOT NULL").distinct().orderBy("exp_id", "entity")
