"""Timeline operators: events of one kind and run over a range of time that is
cut into bins of equal width.

An event ends at tstamp and lasts evt_time. Ranges are [start, start + bins *
delta). All windows are by lane (exp_id, or exp_id and an entity).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.operators.ranges import Over, running, scan


def select_events(df: DataFrame, exp_id: int | None = None, entity: str | None = None, value: int | None = None, aux: str | None = None, aux_value: int | None = None) -> DataFrame:
    """Events of a run, entity and tag, ordered by tag, entity and time."""
    for column, wanted in (("exp_id", exp_id), (entity, value), (aux, aux_value)):
        if column and wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df.orderBy(*[c for c in (aux, entity) if c], "tstamp", "row_id")


def has_data(df: DataFrame, entity: str) -> DataFrame:
    """(exp_id, entity, n): runs and entities that have events."""
    return df.groupBy("exp_id", F.col(entity).cast("bigint").alias("entity")).agg(F.count("*").alias("n"))


def _bin(ts: Column, start: int, delta: int) -> Column:
    return F.call_function("div", ts - F.lit(start), F.lit(delta).cast("bigint"))


def in_range(df: DataFrame, start: int, delta: int, bins: int, tail: bool = False, lane: Sequence[str] = ("exp_id",)) -> DataFrame:
    """Events that end in the range. With tail, also the next one of each lane,
    if it starts before the range ends (durations are shown)."""
    end = start + bins * delta
    inside = df.where((F.col("tstamp") >= start) & (F.col("tstamp") < end))
    if not tail:
        return inside
    after = df.where(F.col("tstamp") >= end).groupBy(*lane).agg(F.min_by(F.struct(*df.columns), F.struct("tstamp", "row_id")).alias("e")).select("e.*")
    return inside.unionByName(after.where(F.col("tstamp") - F.coalesce("evt_time", F.lit(0)) < end))


def binned(df: DataFrame, start: int, delta: int, bins: int, value: Column | None = None, durations: bool = False, lane: Sequence[str] = (), dense: bool = False, tail: bool = False) -> DataFrame:
    """(lane, bin, value): events in a bin, or the sum of a value; an event
    stands in the bin that it ends in, with durations in the one it starts in
    (the first, if that lies before the range). dense fills empty bins of all
    lanes with 0."""
    at = F.greatest(F.col("tstamp") - F.coalesce("evt_time", F.lit(0)), F.lit(start)) if durations else F.col("tstamp")
    rows = in_range(df, start, delta, bins, tail, lane).withColumn("bin", F.least(_bin(at, start, delta), F.lit(bins - 1)))
    out = rows.groupBy(*lane, "bin").agg((F.count("*") if value is None else F.coalesce(F.sum(value), F.lit(0))).alias("value"))
    if not dense:
        return out
    every = df.select(*lane).distinct() if lane else df.sparkSession.range(1).select()
    grid = every.select(*lane, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return grid.join(out, [*lane, "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("bigint")))


def state_spread(df: DataFrame, start: int, delta: int, bins: int, state: str = "mstate", states: int = 12, weight: Column | None = None, widen: int = 0, lane: Sequence[str] = (), tail: bool = False) -> DataFrame:
    """(lane, bin, state, value): the weight of each event spread over the bins
    that it lasts for. Whole bins get weight / (duration / delta), the first
    and last what they cover of it, events that the range cuts a whole share
    there; every addition is cut to an integer. Codes outside 0..states-1 count
    as the last. weight: given for clock states, else the duration, 1 if it is
    0; widen: one tick, for clock states shown with durations."""
    end = start + bins * delta
    rows = in_range(df, start, delta, bins, tail, lane)
    dur = F.coalesce(F.col("evt_time"), F.lit(0)).cast("bigint")
    code = F.when(F.col(state).between(0, states - 1), F.col(state)).otherwise(states - 1).cast("int")
    w = weight if weight is not None else F.when(dur + widen != 0, dur + widen).otherwise(1)
    rows = rows.select(*lane, code.alias("state"), w.cast("bigint").alias("w"), (dur + widen).alias("dur"), (F.col("tstamp") - dur - widen).alias("from"), F.col("tstamp").alias("to"))
    rows = rows.withColumn("lo", _bin(F.greatest("from", F.lit(start)), start, delta)).withColumn("hi", _bin(F.least("to", F.lit(end - 1)), start, delta))
    share = F.when(F.col("lo") == F.col("hi"), F.col("w").cast("double")).otherwise(F.col("w") / (F.col("dur").cast("double") / delta))
    rows = rows.withColumn("share", share)
    # an event of any length is at most four edges: what its first and last bins get, and where its whole bins and its cover begin and end
    begin = lambda b: F.col(b) * delta + start
    first = F.when(F.col("from") < begin("lo"), F.col("share")).otherwise(F.col("share") * ((begin("lo") + delta - 1 - F.col("from")).cast("double") / delta))
    last = F.when(F.col("to") > begin("hi") + delta - 1, F.col("share")).otherwise(F.col("share") * ((F.col("to") - begin("hi")).cast("double") / delta))
    whole, zero = F.col("share").cast("bigint"), F.lit(0).cast("bigint")
    edge = lambda b, add, step, cover: F.struct(b.cast("bigint").alias("bin"), add.cast("bigint").alias("add"), step.cast("bigint").alias("step"), F.lit(cover).cast("bigint").alias("cover"))
    lo, hi = F.col("lo"), F.col("hi")
    one = F.array(edge(lo, whole, zero, 1), edge(hi + 1, zero, zero, -1))
    many = F.array(edge(lo, first, zero, 1), edge(lo + 1, zero, whole, 0), edge(hi, last, -whole, 0), edge(hi + 1, zero, zero, -1))
    edges = rows.select(*lane, "state", F.inline(F.when(lo == hi, one).otherwise(many)))
    edges = edges.groupBy(*lane, "state", "bin").agg(F.sum("add").alias("add"), F.sum("step").alias("step"), F.sum("cover").alias("cover"))
    # bins + 1 rows at most for each lane and state
    w = Window.partitionBy(*lane, "state").orderBy("bin")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    levels = edges.select(*lane, "state", F.col("bin").alias("edge"), "add", F.sum("step").over(upto).alias("level"), F.sum("cover").over(upto).alias("covered"), F.lead("bin").over(w).alias("next")).where("covered > 0")
    spread = levels.withColumn("bin", F.explode(F.sequence("edge", F.col("next") - 1)))
    return spread.select(*lane, "bin", "state", (F.col("level") + F.when(F.col("bin") == F.col("edge"), F.col("add")).otherwise(0)).alias("value"))


def high_water(df: DataFrame, value: str, start: int, delta: int, bins: int, lane: Sequence[str] = ("exp_id",)) -> DataFrame:
    """(lane, bin, value) for all bins: the largest value in a bin, 0 at least
    (but not in bin 0 where a row before the range carries over into it); a bin
    without rows has the last value before it, 0 if there is none."""
    at = F.when(F.col("tstamp") < start, F.lit(-1)).when(F.col("tstamp") >= start + bins * delta, F.lit(bins)).otherwise(_bin(F.col("tstamp"), start, delta)).cast("bigint")
    # bin -1 is what comes before the range; rows after it only say that the lane exists
    per = df.groupBy(*lane, at.alias("bin")).agg(F.max(F.col(value).cast("bigint")).alias("top"), F.max_by(F.col(value).cast("bigint"), F.struct("tstamp", "row_id")).alias("last"))
    grid = per.select(*lane).distinct().select("*", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    before = Window.partitionBy(*lane).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(per, [*lane, "bin"], "left").withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("bin >= 0")
    zero = F.lit(0).cast("bigint")
    carries = (F.col("bin") == 0) & F.col("carried").isNotNull()
    shown = F.when(carries, F.greatest("top", "carried")).when(F.col("top").isNotNull(), F.greatest("top", zero)).otherwise(F.coalesce("carried", zero))
    return filled.select(*lane, "bin", shown.alias("value"))


def representatives(df: DataFrame, start: int, delta: int, bins: int, reverse: bool = False, lane: Sequence[str] = ("exp_id",), tail: bool = False) -> DataFrame:
    """(lane, bin, row_id, tstamp, evt_time): one event for each bin: the first
    of the bin that it ends in, or, in reverse, the latest of the bin that it
    starts in."""
    at = F.greatest(F.col("tstamp") - F.coalesce("evt_time", F.lit(0)), F.lit(start)) if reverse else F.col("tstamp")
    rows = in_range(df, start, delta, bins, tail, lane).withColumn("bin", F.least(_bin(at, start, delta), F.lit(bins - 1)))
    event, order = F.struct("row_id", "tstamp", F.coalesce("evt_time", F.lit(0)).alias("evt_time")), F.struct("tstamp", "row_id")
    picked = rows.groupBy(*lane, "bin").agg((F.max_by(event, order) if reverse else F.min_by(event, order)).alias("e"))
    return picked.select(*lane, "bin", "e.*")


def prune_hidden(reps: DataFrame, lane: Sequence[str] = ("exp_id",)) -> DataFrame:
    """Drops events that a later one that started no later hides. The least
    start so far is carried over ranges of time, from the latest event back."""
    rows = reps.withColumn("__start", F.col("tstamp") - F.col("evt_time")).withColumn("__back", -F.col("tstamp")).withColumn("__row", -F.col("row_id"))
    seen = scan(rows, lane, ["__back", "__row"], {"__least": Over("least", F.col("__start"), before=True)})
    return seen.where(F.col("__least").isNull() | (F.col("__start") < F.col("__least"))).select(*reps.columns)


def representative_rows(reps: DataFrame, start: int, delta: int, bins: int, durations: bool = False, lane: Sequence[str] = ("exp_id",)) -> DataFrame:
    """(lane, row_id, start_bin, n_bins, time_start, time_end): a start bin
    that the event before covers moves past its end."""
    dur = F.col("evt_time") if durations else F.lit(0)
    end_bin = F.least(_bin(F.col("tstamp"), start, delta), F.lit(bins - 1))
    rows = scan(reps.withColumn("__end", end_bin), lane, ["tstamp", "row_id"], {"__prev": Over("latest", F.col("__end"), before=True)})
    first = F.greatest(_bin(F.col("tstamp") - dur, start, delta), F.coalesce("__prev", F.lit(-1)) + 1)
    return rows.select(*lane, "row_id", first.alias("start_bin"), (F.col("__end") - first + 1).alias("n_bins"), (F.col("tstamp") - dur).alias("time_start"), F.col("tstamp").alias("time_end"))


def lookup(df: DataFrame, at: int, relation: str, lane: Sequence[str] = ("exp_id",)) -> DataFrame:
    """(lane, row_id, tstamp): the event of each lane next to a time: the last
    with < or <=, the first with >, >= or =."""
    cond = {"<": F.col("tstamp") < at, "<=": F.col("tstamp") <= at, "=": F.col("tstamp") == at, ">=": F.col("tstamp") >= at, ">": F.col("tstamp") > at}[relation]
    event, order = F.struct("row_id", "tstamp"), F.struct("tstamp", "row_id")
    pick = F.max_by(event, order) if relation.startswith("<") else F.min_by(event, order)
    return df.where(cond).groupBy(*lane).agg(pick.alias("e")).select(*lane, "e.*")


def nearest(df: DataFrame, at: int, lane: Sequence[str] = ("exp_id",), direction: int = 0) -> DataFrame:
    """(lane, row_id, tstamp): of the last event before a time and the first
    from it on the closer one; the later one counts from where it starts. A
    direction below 0 takes the last event up to the time, if there is one,
    then, like one above 0, the first from it on."""
    event, order = F.struct("row_id", "tstamp", F.coalesce("evt_time", F.lit(0)).alias("evt_time")), F.struct("tstamp", "row_id")
    last = lambda cond: F.max_by(F.when(cond, event), F.when(cond, order))
    first = lambda cond: F.min_by(F.when(cond, event), F.when(cond, order))
    t = F.col("tstamp")
    sides = df.groupBy(*lane).agg(last(t < at).alias("l"), last(t <= at).alias("e"), first(t >= at).alias("r"))
    nearer = F.lit(at) - F.col("l.tstamp") > F.col("r.tstamp") - F.col("r.evt_time") - at
    generic = F.when(F.col("l").isNull() | nearer, F.col("r")).otherwise(F.col("l"))
    best = F.coalesce(*([F.col("e")] if direction < 0 else []), *([F.col("r")] if direction else []), generic)
    return sides.withColumn("best", best).select(*lane, "best.row_id", "best.tstamp")


def _around(probes: DataFrame, df: DataFrame, lane: Sequence[str], at: str, sides: Sequence[str]) -> DataFrame:
    """probes with the event (row_id, tstamp, evt_time) of their lane on each
    of the sides: the last with < or <=, the first with > or >=. Events and probes are
    dealt by ranges of time, once for each direction."""
    event = F.struct("row_id", "tstamp", F.coalesce("evt_time", F.lit(0).cast("bigint")).cast("bigint").alias("evt_time"))
    kind = "struct<row_id:bigint,tstamp:bigint,evt_time:bigint>"
    made = df.select(*lane, F.col("tstamp").alias("__t"), F.col("row_id").cast("bigint").alias("__row"), event.cast(kind).alias("__event")).withColumn("__probe", F.lit(0))
    out = probes
    for back in (False, True):
        wanted = [s for s in sides if s.startswith(">") == back]
        if not wanted:
            continue
        names = out.columns
        tie = F.xxhash64(*[F.col(f"`{c}`") for c in probes.columns])
        asked = out.withColumn("__t", F.col(at)).withColumn("__row", tie).withColumn("__event", F.lit(None).cast(kind)).withColumn("__probe", F.lit(1))
        both = asked.unionByName(made, allowMissingColumns=True)
        if back:
            both = both.withColumn("__t", -F.col("__t")).withColumn("__row", F.when(F.col("__probe") == 0, -F.col("__row")).otherwise(F.col("__row")))
        for side in wanted:
            # at one time a probe comes before the events, or, to see them too, after
            rank = F.when(F.col("__probe") == 1, F.lit(2 if side.endswith("=") else 0)).otherwise(F.lit(1))
            both = scan(both.withColumn("__rank", rank), lane, ["__t", "__rank", "__row"], {f"__{side}": Over("latest", F.col("__event"))}).drop("__rank")
        out = both.where("__probe = 1").select(*names, *[f"`__{s}`" for s in wanted])
    return out


def lookup_all(probes: DataFrame, df: DataFrame, relation: str, lane: Sequence[str] = ("exp_id",), at: str = "at") -> DataFrame:
    """lookup for a table of (lane, at, ...): probes with row_id and tstamp of
    their event, null where there is none."""
    side = ">=" if relation == "=" else relation
    found = F.col(f"`__{side}`")
    if relation == "=":
        found = F.when(found["tstamp"] == F.col(at), found)
    return _around(probes, df, lane, at, [side]).select(*probes.columns, found["row_id"].alias("row_id"), found["tstamp"].alias("tstamp"))


def nearest_all(probes: DataFrame, df: DataFrame, lane: Sequence[str] = ("exp_id",), at: str = "at", direction: int = 0) -> DataFrame:
    """nearest for a table of (lane, at, ...): probes with row_id and tstamp of
    their event, null where the lane has none."""
    rows = _around(probes, df, lane, at, ["<", "<=", ">="] if direction < 0 else ["<", ">="])
    left, right = F.col("`__<`"), F.col("`__>=`")
    nearer = F.col(at) - left["tstamp"] > right["tstamp"] - right["evt_time"] - F.col(at)
    generic = F.when(left.isNull() | nearer, right).otherwise(left)
    best = F.coalesce(*([F.col("`__<=`")] if direction < 0 else []), *([right] if direction else []), generic)
    return rows.withColumn("__best", best).select(*probes.columns, "__best.row_id", "__best.tstamp")


def step(df: DataFrame, n: int, lane: Sequence[str] = ("exp_id",)) -> DataFrame:
    """(lane, row_id, to_row, center): for each event the one n further on (or
    back), and the middle of its time; NULL where there is none."""
    center = F.col("tstamp") - F.call_function("div", F.coalesce("evt_time", F.lit(0)).cast("bigint"), F.lit(2).cast("bigint"))
    placed = running(df.select(*lane, "tstamp", "row_id", center.alias("center")), lane, ["tstamp", "row_id"], {"__place": F.lit(1).cast("bigint")})
    further = placed.select(*[F.col(c).alias(f"__{c}") for c in lane], F.col("row_id").alias("to_row"), "center", (F.col("__place") - n).alias("__from"))
    same = F.col("__place") == F.col("__from")
    for c in lane:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return placed.drop("center").join(further, same, "left").select(*lane, "row_id", "to_row", "center")


def event_detail(df: DataFrame, stacks: DataFrame, states: DataFrame, row_ids: Sequence[int]) -> DataFrame:
    """The events with these numbers, with state name and stack."""
    rows = df.where(F.col("row_id").isin(list(row_ids)))
    return rows.join(stacks, ["exp_id", "frinfo"], "left").join(states.select(F.col("value").alias("mstate"), F.col("name").alias("state")), "mstate", "left")
