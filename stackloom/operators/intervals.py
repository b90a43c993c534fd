"""Interval tables and lookups in them.

A range join is an equi-join on buckets: an interval is entered in each bucket
that it touches, long ones (more than ``fanout`` buckets) in buckets that are
``fanout`` times as wide, and so on; a probe asks one bucket on each level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.operators.boxes import box_join
from stackloom.operators.ranges import Over, scan
from stackloom.tables import stored

FOREVER = 2**63 - 1
UNKNOWN = "<Unknown>"
LEVELS = 6
#: ns of the smallest buckets that thread intervals are entered in
THREAD_WIDTH = 2**40


def _div(a: Column, b: int) -> Column:
    """Floor of a / b, for b > 0."""
    return F.when(a >= 0, F.call_function("div", a, F.lit(b).cast("bigint"))).otherwise(-F.call_function("div", -a + (b - 1), F.lit(b).cast("bigint")))


def range_join(probes: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: int, keys: Sequence[str] = (), fanout: int = 16) -> DataFrame:
    """Inner join of probes with the intervals that have low <= at < high and
    equal keys; high may be NULL for no end. Columns other than the keys must
    differ."""
    wide = [w for i in range(LEVELS) if (w := width * fanout**i) < 2**62]
    levels = len(wide)
    end = F.coalesce(F.col(high), F.lit(FOREVER)) - 1
    # the first level on which the interval touches no more than fanout buckets; the last one takes the rest whole
    level = F.lit(levels).cast("int")
    for i in reversed(range(levels)):
        level = F.when(_div(end, wide[i]) - _div(F.col(low), wide[i]) < fanout, F.lit(i)).otherwise(level)
    buckets = F.lit(None).cast("array<bigint>")
    for i in range(levels):
        buckets = F.when(F.col("__level") == i, F.sequence(_div(F.col(low), wide[i]), _div(end, wide[i]))).otherwise(buckets)
    entered = intervals.where(F.col(low) <= end).withColumn("__level", level).withColumn("__bucket", F.explode(F.coalesce(buckets, F.array(F.lit(0).cast("bigint")))))
    entered = stored(entered, "entered")
    used = {r[0] for r in entered.select("__level").distinct().collect()}  # at most LEVELS + 1 numbers
    asked = [F.struct(F.lit(i).alias("__level"), _div(F.col(at), w).alias("__bucket")) for i, w in enumerate(wide) if i in used]
    asked += [F.struct(F.lit(levels).alias("__level"), F.lit(0).cast("bigint").alias("__bucket"))] if levels in used or not used else []
    probing = probes.where(F.col(at).isNotNull()).select("*", F.inline(F.array(*asked)))
    joined = probing.join(entered, [*keys, "__level", "__bucket"])
    return joined.where((F.col(low) <= F.col(at)) & (F.col(at) <= end)).drop("__level", "__bucket")


def first_interval(probes: DataFrame, intervals: DataFrame, row: Sequence[str], at: str, low: str, high: str, order: str, value: str, width: int, keys: Sequence[str] = ("exp_id",), closed: bool = True) -> DataFrame:
    """Adds value, that of the first interval by order that holds the probe;
    NULL if none does. row names a probe; closed intervals hold their end."""
    inner = intervals.select(*keys, F.col(low).alias("__low"), (F.when(F.col(high) < FOREVER, F.col(high) + 1).otherwise(F.lit(FOREVER)) if closed else F.col(high)).alias("__high"), F.col(order).alias("__order"), F.col(value).alias("__value"))
    hit = range_join(probes.select(*dict.fromkeys([*keys, *row, at])), inner, at, "__low", "__high", width, keys)
    best = hit.groupBy(*row).agg(F.min_by("__value", "__order").alias(value))
    return probes.join(best, list(row), "left")


def resolve_addresses(probes: DataFrame, segments: DataFrame, row: Sequence[str], address: str, at: str) -> DataFrame:
    """Adds function_id: that of the live segment that holds the address; the
    last to be loaded, then the highest base, then the last recorded counts.
    NULL if there is none. segments: (base, size, load_ns, unload_ns,
    function_id, ord). Address and time are joined together, so that a base that
    is loaded again and again is met once."""
    inner = segments.select(F.col("base").alias("__base"), (F.col("base") + F.col("size")).alias("__top"), F.col("load_ns").alias("__load"), F.col("unload_ns").alias("__unload"), F.col("function_id").alias("__function"), F.col("ord").alias("__ord"))
    live = box_join(probes.select(*dict.fromkeys([*row, address, at])), inner, [(address, "__base", "__top"), (at, "__load", "__unload")])
    best = live.groupBy(*row).agg(F.max_by("__function", F.struct("__load", "__base", "__ord")).alias("function_id"))
    return probes.join(best, list(row), "left")


def as_of(probes: DataFrame, versions: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Adds value: that of the latest version of the key not after the probe's
    time (of equal ones the largest); NULL before the first. Versions and probes
    are dealt by ranges of key and time, and the last version of a range is
    carried on into the next, so a key may hold all rows."""
    versions = versions.groupBy(F.col(key), F.col(since).alias("__t")).agg(F.max(value).alias("__value"))
    left = probes.withColumn("__t", F.col(at)).withColumn("__probe", F.lit(1)).withColumn("__value", F.lit(None).cast(dict(versions.dtypes)["__value"]))
    both = left.unionByName(versions.withColumn("__probe", F.lit(0)), allowMissingColumns=True)
    # probes of one key and time needn't be in one range
    both = both.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in probes.columns if not probes.schema[c].dataType.typeName() == "map"]))
    found = scan(both, [key], ["__t", "__probe", "__tie"], {"__found": Over("latest", F.col("__value"))})
    return found.where("__probe = 1").drop(*({value} & set(probes.columns))).withColumnRenamed("__found", value).select(*dict.fromkeys([*probes.columns, value]))


def densify(rows: DataFrame, tid: str, order: str, out: str) -> DataFrame:
    """Adds out: 1, 2, 3 ... for the ids of a run in the order in which they
    were first seen."""
    first = rows.groupBy("exp_id", tid).agg(F.min(order).alias("__first"))
    number = first.withColumn(out, F.row_number().over(Window.partitionBy("exp_id").orderBy("__first"))).drop("__first")
    return rows.join(number, ["exp_id", tid], "left")


def gc_pairs(log: DataFrame) -> DataFrame:
    """(exp_id, id, start_ns, end_ns) from (exp_id, row_id, kind start/end,
    tstamp): a start while one is open is ignored, an end moves the end of the
    last event even if that is closed, an end before all starts at 0."""
    w = Window.partitionBy("exp_id").orderBy("row_id")
    opens = (F.col("kind") == "start") & (F.coalesce(F.lag("kind").over(w), F.lit("end")) == "end")
    rows = log.withColumn("__open", opens).withColumn("__island", F.sum(F.col("__open").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    events = rows.groupBy("exp_id", "__island").agg(
        F.when(F.col("__island") == 0, F.lit(0).cast("bigint")).otherwise(F.min(F.when(F.col("__open"), F.col("tstamp")))).alias("start_ns"),
        F.coalesce(F.max_by("tstamp", F.when(F.col("kind") == "end", F.col("row_id"))), F.lit(FOREVER)).alias("end_ns"),
    )
    return events.withColumn("id", F.row_number().over(Window.partitionBy("exp_id").orderBy("__island")).cast("bigint")).select("exp_id", "id", "start_ns", "end_ns")


def gc_clip(events: DataFrame, experiments: DataFrame) -> DataFrame:
    """Events clipped to the run, those outside dropped, the rest renumbered."""
    rows = events.join(experiments.select("exp_id", F.col("start_ns").alias("__start"), F.col("last_event_ns").alias("__last")), "exp_id")
    rows = rows.where((F.col("end_ns") >= F.col("__start")) & (F.col("start_ns") <= F.col("__last")))
    rows = rows.withColumn("start_ns", F.greatest("start_ns", "__start")).withColumn("end_ns", F.least("end_ns", "__last"))
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("exp_id").orderBy("id")).cast("bigint")).select("exp_id", "id", "start_ns", "end_ns")


def gc_duration(clipped: DataFrame) -> DataFrame:
    return clipped.groupBy("exp_id").agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("gc_duration_ns"))


def interval_events(intervals: DataFrame, number: str) -> DataFrame:
    """(exp_id, row_id, tstamp, evt_time): intervals as events that end at
    their time stamp."""
    return intervals.select("exp_id", F.col(number).cast("bigint").alias("row_id"), F.col("end_ns").alias("tstamp"), (F.col("end_ns") - F.col("start_ns")).alias("evt_time"))


def sample_intervals(snapshots: DataFrame, counters: Sequence[str], labels: DataFrame | None = None) -> DataFrame:
    """(exp_id, number, start_ns, end_ns, counters as differences[, start_label,
    end_label]) from cumulative snapshots (exp_id, rec, tstamp, counters). The
    first is no sample. labels: (exp_id, number, label); a sample starts with
    the label that the one before ends with."""
    w = Window.partitionBy("exp_id").orderBy("rec")
    rows = snapshots.select("exp_id", "rec", F.col("tstamp").alias("end_ns"), (F.lag("tstamp").over(w) + 1).alias("start_ns"), *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in counters], (F.row_number().over(w) - 1).cast("bigint").alias("number"))
    rows = rows.where("number > 0").select("exp_id", "number", "start_ns", "end_ns", *counters)
    if labels is None:
        return rows
    ends = labels.select("exp_id", F.col("number").cast("bigint").alias("number"), F.col("label").alias("end_label"))
    starts = ends.select("exp_id", (F.col("number") + 1).alias("number"), F.col("end_label").alias("start_label"))
    return rows.join(starts, ["exp_id", "number"], "left").join(ends, ["exp_id", "number"], "left").withColumn("start_label", F.coalesce("start_label", F.lit("<unknown>"))).withColumn("end_label", F.coalesce("end_label", F.lit("<unknown>")))


def label_chain(labels: DataFrame) -> DataFrame:
    """(exp_id, id, start_label, end_label): id 0 sets the first label, each
    sample starts with the label before its own."""
    w = Window.partitionBy("exp_id").orderBy("id")
    return labels.select("exp_id", "id", F.lag("label").over(w).alias("start_label"), F.col("label").alias("end_label")).where("id > 0")


def thread_intervals(log: DataFrame) -> DataFrame:
    """(exp_id, jthr_id, tid, name, group_name, start_ns, end_ns) from rows
    (exp_id, row_id, tid, kind start/end, tstamp, name, group_name): every end
    closes the first interval of its thread, which starts at 0 if an end comes
    first; later starts stay open."""
    w = Window.partitionBy("exp_id", "tid").orderBy("row_id")
    rows = log.withColumn("__n", F.row_number().over(w))
    first = rows.groupBy("exp_id", "tid").agg(F.max_by("tstamp", F.when(F.col("kind") == "end", F.col("row_id"))).alias("__end"))
    made = rows.where("__n = 1 OR kind = 'start'").join(first, ["exp_id", "tid"], "left")
    made = made.withColumn("start_ns", F.when(F.col("kind") == "end", F.lit(0).cast("bigint")).otherwise(F.col("tstamp"))).withColumn("end_ns", F.when(F.col("__n") == 1, F.col("__end")))
    number = F.row_number().over(Window.partitionBy("exp_id").orderBy("row_id")).cast("bigint")
    return made.withColumn("jthr_id", number).select("exp_id", "jthr_id", "tid", "name", "group_name", "start_ns", "end_ns")


def thread_at(probes: DataFrame, threads: DataFrame, row: Sequence[str], width: int = THREAD_WIDTH) -> DataFrame:
    """Adds jthr_id: the first interval of the probe's thread that holds its
    time, 0 if none does."""
    inner = threads.select("exp_id", F.col("tid").alias("thrid"), F.col("jthr_id").alias("__j"), "start_ns", "end_ns")
    asked = probes.select("exp_id", "thrid", "tstamp", *[c for c in row if c not in ("exp_id", "thrid", "tstamp")])
    hit = range_join(asked, inner, "tstamp", "start_ns", "end_ns", width, ("exp_id", "thrid"))
    return probes.join(hit.groupBy(*row).agg(F.min("__j").alias("jthr_id")), list(row), "left").withColumn("jthr_id", F.coalesce("jthr_id", F.lit(0).cast("bigint")))


def representative_thread(threads: DataFrame) -> DataFrame:
    """(exp_id, tid, jthr_id, name): the first interval of each thread."""
    return threads.groupBy("exp_id", "tid").agg(F.min("jthr_id").alias("jthr_id"), F.min_by("name", "jthr_id").alias("name"))


def segment_lifetimes(log: DataFrame) -> DataFrame:
    """(exp_id, base, size, name, ord, load_ns, unload_ns) from map rows (exp_id,
    ord, kind map/unmap, tstamp, base, size, name): an unmap closes the live
    segment of its base that was mapped last. Brackets are paired by depth:
    the k-th opening of a depth goes with the k-th closing of it."""
    w = Window.partitionBy("exp_id", "base").orderBy("tstamp", "ord")
    step = F.when(F.col("kind") == "map", 1).otherwise(-1)
    rows = log.withColumn("__sum", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # an unmap with nothing live does nothing: the depth is the height over the lowest sum so far
    rows = rows.withColumn("__floor", F.least(F.min("__sum").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.withColumn("__before", F.lag("__floor", 1, 0).over(w))
    rows = rows.where((F.col("kind") == "map") | (F.col("__floor") == F.col("__before")))
    depth = F.col("__sum") - F.col("__floor") + F.when(F.col("kind") == "map", 0).otherwise(1)
    rows = rows.withColumn("__depth", depth)
    pair = Window.partitionBy("exp_id", "base", "__depth").orderBy("tstamp", "ord")
    rows = rows.withColumn("__next", F.lead(F.struct("kind", "tstamp")).over(pair)).where("kind = 'map'")
    return rows.select("exp_id", "base", "size", "name", "ord", F.col("tstamp").alias("load_ns"), F.when(F.col("__next.kind") == "unmap", F.col("__next.tstamp")).alias("unload_ns"))


def drop_duplicate_segments(segments: DataFrame) -> DataFrame:
    """Of live segments with equal base and size, one of whose names is part of
    the other's, the first stays."""
    w = Window.partitionBy("exp_id", "base", "size").orderBy("load_ns", "ord")
    prior = F.lag(F.struct("name", "unload_ns")).over(w)
    rows = segments.withColumn("__prior", prior)
    live = F.col("__prior.unload_ns").isNull() | (F.col("__prior.unload_ns") > F.col("load_ns"))
    same = F.contains("name", "__prior.name") | F.contains("__prior.name", "name")
    return rows.where(F.col("__prior").isNull() | ~(live & F.coalesce(same, F.lit(False)))).drop("__prior")


def overlapping_segments(segments: DataFrame) -> DataFrame:
    """(exp_id, a, b): segments b that were loaded while a, loaded before, was
    live and shared addresses with it. Two boxes of addresses and time that overlap
    do so from the higher base and the later load on. Where one segment has
    both, that point lies in the box of the other; where each has one, the life of
    the one with the higher base crosses the addresses of the other at its load.
    So two joins in both dimensions find each pair once."""
    forever = F.lit(FOREVER)
    side = lambda n: segments.select("exp_id", F.col("ord").alias(n), F.col("base").alias(f"{n}_base"), (F.col("size") <= 0).alias(f"{n}_void"), (F.col("base") + F.col("size")).alias(f"{n}_top"), F.col("load_ns").alias(f"{n}_load"), F.coalesce("unload_ns", forever).alias(f"{n}_unload"))
    x, y = side("x"), side("y")
    # of two equal bases that of a segment without addresses is the higher one: it may lie in the other
    higher = F.struct("x_base", "x_void", "x") > F.struct("y_base", "y_void", "y")
    later = F.struct("x_load", "x") > F.struct("y_load", "y")
    both_live = (F.col("x_load") < F.col("y_unload")) & (F.col("y_load") < F.col("x_unload"))
    inside = box_join(x, y, [("x_base", "y_base", "y_top"), ("x_load", "y_load", "y_unload")], ["exp_id"]).where(higher & later & both_live)
    across = box_join(x, y, [("x_base", "y_base", "y_top"), ("y_load", "x_load", "x_unload")], ["exp_id"]).where(higher & ~later & both_live)
    return inside.select("exp_id", F.col("y").alias("a"), F.col("x").alias("b")).unionByName(across.select("exp_id", F.col("x").alias("a"), F.col("y").alias("b")))


def last_event(kinds: Sequence[DataFrame]) -> DataFrame:
    """(exp_id, last_event_ns) over tables of events."""
    rows = None
    for df in kinds:
        part = df.groupBy("exp_id").agg(F.max("tstamp").alias("tstamp"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("exp_id").agg(F.max("tstamp").alias("last_event_ns"))


def non_paused(log: DataFrame, last: DataFrame) -> DataFrame:
    """(exp_id, non_paused_ns): time from each resume to the next pause, the
    last one to the last event. log: (exp_id, row_id, kind, tstamp)."""
    w = Window.partitionBy("exp_id").orderBy("row_id")
    rows = log.where("kind IN ('pause', 'resume')").withColumn("__prev", F.lag("kind").over(w)).where("__prev IS NULL OR __prev <> kind")
    rows = rows.withColumn("__next", F.lead("tstamp").over(w)).where("kind = 'resume'").join(last, "exp_id", "left")
    return rows.groupBy("exp_id").agg(F.sum(F.coalesce("__next", "last_event_ns") - F.col("tstamp")).alias("non_paused_ns"))


def stack_context(kinds: Sequence[DataFrame]) -> DataFrame:
    """(exp_id, frinfo, thrid, tstamp): where each stack was first seen; tables
    are given in their order of rank."""
    rows = None
    for rank, df in enumerate(kinds):
        part = df.select("exp_id", "frinfo", F.struct(F.lit(rank).alias("rank"), "row_id").alias("ord"), F.struct("thrid", "tstamp").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("exp_id", "frinfo").agg(F.min_by("at", "ord").alias("at")).select("exp_id", "frinfo", "at.thrid", "at.tstamp")


def attach_stacks(events: DataFrame, stacks: DataFrame) -> DataFrame:
    """events with their stack; a single unknown frame where there is none."""
    return events.join(stacks.select("exp_id", "frinfo", "stack"), ["exp_id", "frinfo"], "left").withColumn("stack", F.coalesce("stack", F.array(F.lit(UNKNOWN))))


def resolve_stacks(rows: DataFrame, prefer_native: bool = False) -> DataFrame:
    """Adds stack to rows with native array<string>, java array<string>, jthr_id
    (0: none) and group_name: the system frame for threads that are not Java's
    (unless they have a Java stack) or belong to the system group, else the
    Java stack, else the native one, else an unknown frame. So a recording
    without thread records is all system frames; prefer_native shows its native
    stacks instead."""
    java, native = F.size(F.coalesce("java", F.array().cast("array<string>"))) > 0, F.size(F.coalesce("native", F.array().cast("array<string>"))) > 0
    system = ((F.col("jthr_id") == 0) & ~java) | F.coalesce(F.col("group_name") == "system", F.lit(False))
    if prefer_native:
        system = system & ~native
    return rows.withColumn("stack", F.when(system, F.array(F.lit("<JVM-System>"))).when(java, F.col("java")).when(native, F.col("native")).otherwise(F.array(F.lit(UNKNOWN))))


def names_of(rows: DataFrame, functions: DataFrame, key: str = "function_id") -> DataFrame:
    """rows with the name of their function."""
    return rows.join(functions.select(F.col("function_id").alias(key), "name"), key, "left").withColumn("name", F.coalesce("name", F.lit(UNKNOWN)))
