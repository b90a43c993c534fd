"""Measures and their hierarchy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thread states of a clock sample, by code.
STATES = {0: "user", 1: "system", 2: "trap", 3: "text_fault", 4: "data_fault", 5: "kernel_fault", 6: "user_lock", 7: "sleep", 8: "wait_cpu", 9: "stopped", 10: "linux", 11: "kernel"}
CPU_STATES = (0, 1, 2, 10)
NOT_THREAD_STATES = (10, 11)


def cpu_ns(strict: bool = False) -> Column:
    """Time of a clock sample. The condition on states is declared, but only
    strict applies it."""
    ns = F.col("nticks").cast("bigint") * F.col("ptimer_usec") * 1000
    return F.when(F.col("mstate").isin(*CPU_STATES), ns).otherwise(0) if strict else ns


def total_cpu(clock: DataFrame, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    return clock.groupBy(*(keys or [])).agg((F.coalesce(F.sum(cpu_ns(strict)), F.lit(0)) / 1e9).alias("cpu_sec"))


def state_times(clock: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, total_ns, kernel_ns and one column for each of the ten states):
    an extension, these are declared measures that nothing computed."""
    ns = cpu_ns()
    part = lambda cond: F.coalesce(F.sum(F.when(cond, ns)), F.lit(0))
    return clock.groupBy(*(keys or [])).agg(part(~F.col("mstate").isin(*NOT_THREAD_STATES)).alias("total_ns"), part(F.col("mstate") == 11).alias("kernel_ns"), *[part(F.col("mstate") == code).alias(f"{name}_ns") for code, name in STATES.items() if code < 10])


def state_rollup(clock: DataFrame) -> DataFrame:
    """(level1, level2, ns): time by group of states and state, with the sums
    of each group and of all."""
    group = F.when(F.col("mstate").isin(*CPU_STATES), "cpu").when(F.col("mstate").between(3, 5), "fault").otherwise("other")
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return clock.select(group.alias("level1"), names[F.col("mstate")].alias("level2"), cpu_ns().alias("ns")).rollup("level1", "level2").agg(F.sum("ns").alias("ns"))


def metric_columns(metrics: list[str], kinds: str = "ei") -> list[str]:
    """Columns of a table of metrics: e_ exclusive, i_ inclusive, a_ attributed."""
    return [f"{k}_{m}" for m in metrics for k in kinds]


#: Which kinds of a metric a table has.
TABLE_KINDS = {"normal": "ei", "common": "ei", "call": "aei", "index": "e", "source": "i", "heap": "e", "io": "e"}
#: Tables that have metrics of one kind of event alone, and columns that a table has but doesn't show.
TABLE_EVENTS, TABLE_HIDDEN = {"heap": "heap", "io": "io"}, {"call": "ei"}


def project(df: DataFrame, metrics: list[str], table: str, keys: list[str], events: Mapping[str, str] | None = None, hidden: bool = True) -> DataFrame:
    """The columns of a kind of table; absent ones are left out. events: the
    kind of event that a metric is of, for tables of one kind alone. Without hidden,
    columns that the table sorts by but doesn't show are left out too."""
    only = TABLE_EVENTS.get(table)
    of = [m for m in metrics if only is None or (events or {}).get(m, only) == only]
    kinds = [k for k in TABLE_KINDS[table] if hidden or k not in TABLE_HIDDEN.get(table, "")]
    return df.select(*keys, *[c for c in metric_columns(of, "".join(kinds)) if c in df.columns])


def measures(df: DataFrame, keys: list[str], defined: Mapping[str, Column]) -> DataFrame:
    """Named aggregates over keys: metrics that a user defines."""
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in defined.items()])
