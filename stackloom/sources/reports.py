"""Reports and sinks over the tables of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.operators.sorting import limited, sort_result

#: Bits of an experiment's state.
STATE_BITS = {"error": 1, "warning": 2, "incomplete": 4, "broken": 8}
#: Columns that a catalogue hides.
HIDDEN = ("frinfo", "evt_time")


def write_columns(result: DataFrame, columns: Sequence[str], path: str) -> None:
    """Visible columns as Parquet."""
    result.select(*columns).write.mode("overwrite").parquet(path)


def write_text(result: DataFrame, path: str, n: int = 0, delimiter: str = ",") -> None:
    """The first n rows, in order, as one delimited file with a header; for 0
    all rows, as many files as the result has partitions."""
    rows = limited(result, n)
    (rows.coalesce(1) if n else rows).write.mode("overwrite").option("sep", delimiter).csv(path, header=True)


def text_report(table: DataFrame, metric: str, n: int, key: str = "function") -> DataFrame:
    """The first n rows of a table by a metric, the total first."""
    return limited(sort_result(table, metric, key), n)


def experiment_state(flags: dict[str, Column]) -> Column:
    """Sum of the bits of the flags that are set."""
    return sum((F.when(c, F.lit(STATE_BITS[n])).otherwise(F.lit(0)) for n, c in flags.items()), F.lit(0))


def experiment_report(experiments: DataFrame) -> DataFrame:
    """(exp_id, state, info): one line of header text for each experiment."""
    state = experiment_state({"incomplete": F.col("last_event_ns").isNull(), "error": F.col("start_ns").isNull()})
    info = F.concat_ws("; ", F.format_string("Experiment: %s", "path"), F.format_string("Host: %s", "hostname"), F.format_string("Processes: %d", "pid"))
    return experiments.select("exp_id", state.alias("state"), info.alias("info"))


def load_object_list(load_objects: DataFrame) -> DataFrame:
    """Text segments, by name."""
    return load_objects.where("type = 'TEXT'").select("obj_id", "name", "size").orderBy("name", "obj_id")


def time_info(experiments: DataFrame) -> DataFrame:
    """(exp_id, start_ns, end_ns, wall_sec, clock_mhz)."""
    return experiments.select("exp_id", "start_ns", F.col("last_event_ns").alias("end_ns"), ((F.col("last_event_ns") - F.col("start_ns")) / 1e9).alias("wall_sec"), "clock_mhz")


def column_catalogue(tables: dict[str, DataFrame], states: Sequence[str] = ()) -> DataFrame:
    """(kind, column, type, n_rows, n_present, n_states) for the visible columns
    of tables: rows of the table, those that have a value, and for columns of
    states the number of states that occur. One pass over each table."""
    found = None
    for kind, df in tables.items():
        shown = [(c, t) for c, t in df.dtypes if c not in HIDDEN]
        counts = [F.count(F.col(c)).alias(f"present_{c}") for c, _ in shown] + [F.count_distinct(F.col(c)).alias(f"states_{c}") for c, _ in shown if c in states]
        one = [
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n_rows"), F.col(f"present_{c}").alias("n_present"), (F.col(f"states_{c}") if c in states else F.lit(0).cast("bigint")).alias("n_states"))
            for c, t in shown
        ]
        each = df.agg(F.count("*").alias("n_rows"), *counts).select(F.lit(kind).alias("kind"), F.inline(F.array(*one)))
        found = each if found is None else found.unionByName(each)
    return found


def sample_table(samples: DataFrame, low: int, high: int) -> DataFrame:
    """Samples low to high with their labels and use."""
    return samples.where(F.col("number").between(low, high)).orderBy("exp_id", "number")


def gc_table(events: DataFrame) -> DataFrame:
    return events.select("exp_id", "id", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns")).orderBy("exp_id", "id")
