"""Registered queries of the profile-event operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import expressions as ex
from stackloom.functions import text
from stackloom.operators import filters, groups, heap, intervals, metrics, sorting, stacks, timeline
from stackloom.plans import fixtures as fx
from stackloom.registry import ORACLE_SQL, QUERIES, register
from stackloom.sources import experiments as ingest
from stackloom.sources import reports
from stackloom.streaming.bins import store_bins, stored_bins, streamed_bins
from stackloom.tables import folder

__all__ = ["ORACLE_SQL", "QUERIES"]

START, DAY = fx.START_NS, fx.DAY_NS
BINS = 31
NS = "nticks * ptimer_usec * 1000"


# ---- stacks ----


@register("""SELECT function, sum(CASE WHEN function = stack[len(stack)] THEN weight ELSE 0 END)::BIGINT AS excl, sum(weight)::BIGINT AS incl
FROM (SELECT stack, weight, unnest(list_distinct(stack)) AS function FROM samples) GROUP BY function
UNION ALL SELECT '<Total>', sum(weight)::BIGINT, sum(weight)::BIGINT FROM samples""", fx.STACKS)
def function_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.sort_result(stacks.function_table(fx.stacks(spark, sf_dir), "weight"), "incl")


@register("SELECT sum(weight)::BIGINT AS total FROM samples", fx.STACKS)
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.grand_total(fx.stacks(spark, sf_dir), "weight")


_MATCH = """paths AS (SELECT ['<Total>'] || stack AS p, weight AS w FROM samples),
hits AS (SELECT p, w, [d for d in range(0, len(p)) if p[d + 1] = 'view'] AS ms FROM paths),
each_hit AS (SELECT p, w, unnest(ms) AS d, list_max(ms) AS last FROM hits)"""
_MATCH2 = """paths AS (SELECT ['<Total>'] || stack AS p, weight AS w FROM samples),
hits AS (SELECT p, w, [d for d in range(1, len(p)) if p[d] = 'click' AND p[d + 1] = 'view'] AS ms FROM paths),
each_hit AS (SELECT p, w, unnest(ms) AS d, list_max(ms) AS last FROM hits)"""


@register("SELECT p[d] AS neighbour, sum(CASE WHEN d = last THEN w ELSE 0 END)::BIGINT AS attributed FROM each_hit WHERE d >= 1 GROUP BY 1", fx.STACKS, _MATCH)
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.callers(fx.stacks(spark, sf_dir), ["view"], "weight")


@register("SELECT p[d + 2] AS neighbour, sum(CASE WHEN d = last THEN w ELSE 0 END)::BIGINT AS attributed FROM each_hit WHERE d + 1 < len(p) GROUP BY 1", fx.STACKS, _MATCH)
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.callees(fx.stacks(spark, sf_dir), ["view"], "weight")


@register("SELECT p[d - 1] AS neighbour, sum(CASE WHEN d = last THEN w ELSE 0 END)::BIGINT AS attributed FROM each_hit WHERE d >= 2 GROUP BY 1", fx.STACKS, _MATCH2)
def chain_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.callers(fx.stacks(spark, sf_dir), ["click", "view"], "weight")


@register("SELECT p[d + 2] AS neighbour, sum(CASE WHEN d = last THEN w ELSE 0 END)::BIGINT AS attributed FROM each_hit WHERE d + 1 < len(p) GROUP BY 1", fx.STACKS, _MATCH2)
def chain_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.callees(fx.stacks(spark, sf_dir), ["click", "view"], "weight")


_SELF = """SELECT sum(CASE WHEN last = len(p) - 1 THEN w ELSE 0 END)::BIGINT AS attributed, sum(CASE WHEN last = len(p) - 1 THEN w ELSE 0 END)::BIGINT AS excl, sum(w)::BIGINT AS incl
FROM (SELECT p, w, list_max(ms) AS last FROM hits WHERE len(ms) > 0)"""


@register(_SELF, fx.STACKS, _MATCH)
def self_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.self_values(fx.stacks(spark, sf_dir), ["view"], "weight")


@register(_SELF, fx.STACKS, _MATCH2)
def self_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.self_values(fx.stacks(spark, sf_dir), ["click", "view"], "weight")


@register("""SELECT center, role, neighbour, sum(v)::BIGINT AS attributed FROM (
  SELECT p[d + 1] AS center, 'caller' AS role, p[d] AS neighbour, CASE WHEN list_contains(p[d + 2:], p[d + 1]) THEN 0 ELSE w END AS v FROM each_d WHERE d > 0
  UNION ALL SELECT p[d + 1], 'callee', p[d + 2], CASE WHEN list_contains(p[d + 2:], p[d + 1]) THEN 0 ELSE w END FROM each_d WHERE d + 1 < len(p)
  UNION ALL SELECT p[d + 1], 'self', p[d + 1], CASE WHEN d + 1 = len(p) THEN w ELSE 0 END FROM each_d)
GROUP BY ALL""", fx.STACKS, "each_d AS (SELECT p, w, unnest(range(0, len(p))) AS d FROM (SELECT ['<Total>'] || stack AS p, weight AS w FROM samples))")
def caller_callee_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.caller_callee_report(fx.stacks(spark, sf_dir), "weight")


_TREE = "nodes AS (SELECT stack, weight, row_id, unnest(range(0, len(stack) + 1)) AS k FROM paths)"


@register("SELECT array_to_string(stack[:k], '/') AS path, k::INTEGER AS level, sum(weight)::BIGINT AS incl, sum(CASE WHEN k = len(stack) THEN weight ELSE 0 END)::BIGINT AS excl FROM nodes GROUP BY ALL", fx.PATHS, _TREE)
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.path_tree(fx.paths(spark, sf_dir), "weight").select(F.array_join("path", "/").alias("path"), "level", "incl", "excl")


_FLAME = """tree AS (SELECT stack[:k] AS path, k AS level, sum(weight)::BIGINT AS value, min(row_id) AS first FROM nodes GROUP BY ALL),
keyed AS (SELECT t.path, t.level, t.value, list(u.first ORDER BY u.level) AS ord FROM tree t JOIN tree u ON u.path = t.path[:u.level] AND u.level <= t.level GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (ORDER BY level, ord, path) AS idx FROM keyed),
flame AS (SELECT n.idx, coalesce(p.idx, 0) AS parent_idx, n.level::INTEGER AS level, CASE WHEN n.level = 0 THEN '<Total>' ELSE n.path[n.level] END AS function, n.value
  FROM numbered n LEFT JOIN numbered p ON p.path = n.path[:n.level - 1] AND p.level = n.level - 1)"""


def _flame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.flame_levels(fx.paths(spark, sf_dir), "weight", "row_id")


@register("SELECT * FROM flame", fx.PATHS, _TREE, _FLAME)
def flame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flame(spark, sf_dir)


@register("SELECT * FROM flame WHERE parent_idx IN (0, 1, 3)", fx.PATHS, _TREE, _FLAME)
def flame_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.flame_children(_flame(spark, sf_dir), [0, 1, 3])


@register("SELECT idx, function FROM flame WHERE level BETWEEN 1 AND 2", fx.PATHS, _TREE, _FLAME)
def level_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.functions_in_levels(_flame(spark, sf_dir), 1, 2)


@register("SELECT (max(len(stack)) + 1)::INTEGER AS depth FROM samples", fx.STACKS)
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.tree_depth(fx.stacks(spark, sf_dir))


@register("""SELECT function, min(row_id * 100 + d) // 100 AS ord, (min(row_id * 100 + d) % 100)::INTEGER AS depth FROM (
SELECT row_id, unnest(['<Total>'] || stack) AS function, unnest(range(0, len(stack) + 1)) AS d FROM samples) GROUP BY function""", fx.STACKS)
def distinct_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.distinct_functions(fx.stacks(spark, sf_dir), "row_id").select("function", "first.ord", "first.depth")


@register("""SELECT row_id, list_contains(stack, 'error')::BIGINT AS has_error, (list_contains(stack, 'error') OR list_contains(stack, 'signup'))::BIGINT AS some_in,
(list_contains(stack, 'error') AND list_contains(stack, 'signup'))::BIGINT AS all_in,
(contains('/' || array_to_string(stack, '/') || '/', '/click/view/'))::BIGINT AS ordered_in, stack[len(stack)] AS leaf,
array_to_string(list_reverse(['<Total>'] || stack), '/') AS stack_list FROM samples""", fx.STACKS)
def stack_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("stack")
    two = F.array(F.lit("error"), F.lit("signup"))
    return fx.stacks(spark, sf_dir).select("row_id", ex.all_in(F.array(F.lit("error")), s).alias("has_error"), ex.some_in(two, s).alias("some_in"), ex.all_in(two, s).alias("all_in"), ex.ordered_in(F.array(F.lit("click"), F.lit("view")), s).alias("ordered_in"), ex.leaf("stack").alias("leaf"), F.array_join(ex.stack_list("stack", F.lit("<Total>")), "/").alias("stack_list"))


# ---- filters and expressions ----


@register("SELECT row_id, mstate, thrid FROM clock WHERE CASE WHEN mstate = 7 THEN NULL ELSE mstate = 1 END IS DISTINCT FROM FALSE", fx.CLOCK)
def view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = F.when(F.col("mstate") != 7, ex.equal("mstate", 1))
    return filters.view_filter(fx.clock_events(spark, sf_dir), cond).select("row_id", "mstate", "thrid")


@register("SELECT thrid, count(*) AS n FROM clock WHERE thrid IN (SELECT thrid FROM clock GROUP BY thrid ORDER BY sum(nticks) DESC, thrid LIMIT 10) GROUP BY thrid", fx.CLOCK)
def selected_rows_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = fx.clock_events(spark, sf_dir)
    top = clock.groupBy("thrid").agg(F.sum("nticks").alias("t")).orderBy(F.desc("t"), "thrid").limit(10)
    return filters.keep_selected(clock, top, "thrid").groupBy("thrid").agg(F.count("*").alias("n"))


@register("""SELECT row_id, (mstate = 1 AND nticks = 2)::BIGINT AS both_, (mstate = 1 OR nticks = 2)::BIGINT AS either_, ((mstate <> 0) = (nticks <> 0))::BIGINT AS same_,
((mstate <> 0) <> (nticks <> 0))::BIGINT AS other_, (mstate = 0)::BIGINT AS not_, CASE WHEN mstate <> 0 THEN thrid ELSE nticks END AS chosen, (mstate IN (0, 2))::BIGINT AS in_ FROM clock""", fx.CLOCK)
def logical_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ex.equal("mstate", 1), ex.equal("nticks", 2)
    return fx.clock_events(spark, sf_dir).select("row_id", ex.both(a, b).alias("both_"), ex.either(a, b).alias("either_"), ex.same_truth(F.col("mstate"), F.col("nticks")).alias("same_"), ex.other_truth(F.col("mstate"), F.col("nticks")).alias("other_"), ex.negated("mstate").alias("not_"), ex.choose(F.col("mstate"), F.col("thrid"), F.col("nticks")).alias("chosen"), ex.flag(F.col("mstate").isin(0, 2)).alias("in_"))


# a is spread over all 64 bits: a Weyl sequence of the row number
_SPREAD = "((row_id::HUGEINT * 11400714819323198485) % 18446744073709551616)"


@register(f"""SELECT row_id, (CASE WHEN a >= 9223372036854775808 THEN a - 18446744073709551616 ELSE a END)::BIGINT AS a,
((a & 255))::BIGINT AS and_, (s | 255)::BIGINT AS or_, xor(s, 255)::BIGINT AS xor_, (-1 - s)::BIGINT AS not_,
(a < b)::BIGINT AS below, (a > b)::BIGINT AS above, (a <= b)::BIGINT AS at_most, (a >= b)::BIGINT AS at_least,
CASE WHEN b = 0 THEN 0 ELSE (CASE WHEN a // b >= 9223372036854775808 THEN a // b - 18446744073709551616 ELSE a // b END) END::BIGINT AS quotient,
CASE WHEN b = 0 THEN 0 ELSE a % b END::BIGINT AS remainder,
(CASE WHEN (a + b) % 18446744073709551616 >= 9223372036854775808 THEN (a + b) % 18446744073709551616 - 18446744073709551616 ELSE (a + b) % 18446744073709551616 END)::BIGINT AS plus,
(CASE WHEN (a + 18446744073709551616 - b) % 18446744073709551616 >= 9223372036854775808 THEN (a + 18446744073709551616 - b) % 18446744073709551616 - 18446744073709551616 ELSE (a + 18446744073709551616 - b) % 18446744073709551616 END)::BIGINT AS minus,
(CASE WHEN (a * b) % 18446744073709551616 >= 9223372036854775808 THEN (a * b) % 18446744073709551616 - 18446744073709551616 ELSE (a * b) % 18446744073709551616 END)::BIGINT AS times,
(a // 8)::BIGINT AS shift_right,
(CASE WHEN (a * 8) % 18446744073709551616 >= 9223372036854775808 THEN (a * 8) % 18446744073709551616 - 18446744073709551616 ELSE (a * 8) % 18446744073709551616 END)::BIGINT AS shift_left
FROM (SELECT row_id, a, b, (CASE WHEN a >= 9223372036854775808 THEN a - 18446744073709551616 ELSE a END)::BIGINT AS s FROM
 (SELECT row_id, {_SPREAD} AS a, (thrid % 7)::HUGEINT AS b FROM clock))""", fx.CLOCK)
def integer_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.clock_events(spark, sf_dir).select("row_id", ex.times("row_id", ex.number("11400714819323198485")).alias("a"), (F.col("thrid") % 7).alias("b"))
    return rows.select(
        "row_id", "a", ex.bit_and("a", 255).alias("and_"), ex.bit_or("a", 255).alias("or_"), ex.bit_xor("a", 255).alias("xor_"), ex.bit_not("a").alias("not_"),
        ex.below("a", "b").alias("below"), ex.above("a", "b").alias("above"), ex.at_most("a", "b").alias("at_most"), ex.at_least("a", "b").alias("at_least"),
        ex.quotient("a", "b").alias("quotient"), ex.remainder("a", "b").alias("remainder"), ex.plus("a", "b").alias("plus"), ex.minus("a", "b").alias("minus"), ex.times("a", "b").alias("times"),
        ex.shift_right("a", 67).alias("shift_right"), ex.shift_left("a", 67).alias("shift_left"),
    )


@register(f"""SELECT row_id, tstamp - start_ns AS rel, tstamp - start_ns - evt_time AS low, tstamp - start_ns AS high, nticks * ptimer_usec AS tick_usec,
exp_id::BIGINT * 4294967296 + thrid AS handle, exp_id::BIGINT * 4294967296 AS run_handle, (mstate::BIGINT) AS state, NULL::BIGINT AS fraction, 1::BIGINT AS has_cpu, 0::BIGINT AS has_io FROM clock""", fx.CLOCK)
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.clock_events(spark, sf_dir)
    return c.select("row_id", ex.relative_time("tstamp", "start_ns").alias("rel"), ex.low_time("tstamp", "start_ns", "evt_time").alias("low"), ex.high_time("tstamp", "start_ns", "evt_time").alias("high"), ex.tick_usec("nticks", "ptimer_usec").alias("tick_usec"), ex.thread_handle("exp_id", "thrid").alias("handle"), ex.group_handle(0, "exp_id").alias("run_handle"), ex.default_value(c, "mstate", ["mstate"]).alias("state"), ex.default_value(c, "value").alias("fraction"), ex.has_column(c, "CPUID").alias("has_cpu"), ex.has_column(c, "ionbyte").alias("has_io"))


# ---- heap ----


@register("SELECT exp_id, row_id, hleaked::BIGINT AS hleaked, link_row::BIGINT AS link_row FROM matched", fx.HEAP)
def leak_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.leak_match(fx.heap_events(spark, sf_dir)).select("exp_id", "row_id", "hleaked", "link_row")


@register("SELECT a.exp_id, a.row_id, r.row_id AS release_row, r.tstamp AS release_tstamp FROM matched a JOIN matched r ON a.exp_id = r.exp_id AND r.row_id = a.link_row - 1 WHERE a.link_row > 0", fx.HEAP)
def release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.release_rows(heap.leak_match(fx.heap_events(spark, sf_dir)))


def _size_sql(kept: str) -> str:
    return f"""SELECT exp_id, row_id, tstamp, net_alloc::BIGINT AS net_alloc, (sum(net_alloc) OVER w)::BIGINT AS cur_allocs, (sum(leak) OVER w)::BIGINT AS cur_leaks FROM (
  SELECT exp_id, row_id, sum(delta) AS net_alloc, min(ord) AS ord, CASE WHEN max(CASE WHEN NOT own THEN ord END) > max(CASE WHEN own THEN ord END) THEN 0 ELSE coalesce(max(leak), 0) END AS leak FROM (
    SELECT exp_id, row_id, CASE WHEN htype IN (0, 2, 3) THEN hsize ELSE 0 END AS delta, hleaked AS leak, row_id * 2 AS ord, TRUE AS own FROM matched WHERE {kept}
    UNION ALL SELECT exp_id, link_row - 1, -hsize, NULL, row_id * 2 + 1, FALSE FROM matched WHERE {kept} AND link_row > 0)
  GROUP BY exp_id, row_id) JOIN (SELECT exp_id, row_id, tstamp FROM matched) USING (exp_id, row_id)
WINDOW w AS (PARTITION BY exp_id ORDER BY tstamp, ord)"""


@register(_size_sql("TRUE"), fx.HEAP)
def heap_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.heap_size(heap.leak_match(fx.heap_events(spark, sf_dir)))


@register(_size_sql("thrid % 2 = 0"), fx.HEAP)
def heap_size_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = heap.leak_match(fx.heap_events(spark, sf_dir))
    return heap.heap_size(matched, matched.where("thrid % 2 = 0"))


@register("""SELECT exp_id, sum(hsize)::BIGINT AS alloc_bytes, count(*) AS allocs, sum(hleaked)::BIGINT AS leak_bytes, count(CASE WHEN hleaked <> 0 THEN 1 END) AS leaks
FROM matched WHERE htype NOT IN (1, 4) AND hvaddr <> 0 GROUP BY exp_id""", fx.HEAP)
def heap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.heap_metrics(heap.leak_match(fx.heap_events(spark, sf_dir)), ["exp_id"])


# ---- metrics ----


@register(f"SELECT exp_id, sum({NS}) / 1e9 AS cpu_sec FROM clock GROUP BY exp_id", fx.CLOCK)
def total_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.total_cpu(fx.clock_events(spark, sf_dir), ["exp_id"])


@register(f"SELECT exp_id, sum({NS}) / 1e9 AS cpu_sec FROM clock WHERE mstate IN (0, 1, 2, 10) GROUP BY exp_id", fx.CLOCK)
def total_cpu_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.total_cpu(fx.clock_events(spark, sf_dir), ["exp_id"], strict=True)


@register(f"SELECT exp_id, coalesce(sum({NS}) FILTER (mstate NOT IN (10, 11)), 0)::BIGINT AS total_ns, coalesce(sum({NS}) FILTER (mstate = 11), 0)::BIGINT AS kernel_ns, " + ", ".join(f"coalesce(sum({NS}) FILTER (mstate = {k}), 0)::BIGINT AS {n}_ns" for k, n in metrics.STATES.items() if k < 10) + " FROM clock GROUP BY exp_id", fx.CLOCK)
def state_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.state_times(fx.clock_events(spark, sf_dir), ["exp_id"])


@register(f"""SELECT level1, level2, sum(ns)::BIGINT AS ns FROM (SELECT CASE WHEN mstate IN (0, 1, 2, 10) THEN 'cpu' WHEN mstate BETWEEN 3 AND 5 THEN 'fault' ELSE 'other' END AS level1,
CASE mstate WHEN 0 THEN 'user' WHEN 1 THEN 'system' WHEN 2 THEN 'trap' WHEN 7 THEN 'sleep' WHEN 10 THEN 'linux' END AS level2, {NS} AS ns FROM clock) GROUP BY ROLLUP (level1, level2)""", fx.CLOCK)
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.state_rollup(fx.clock_events(spark, sf_dir))


@register("SELECT cpuid, max(nticks) AS longest, count(DISTINCT thrid) AS threads FROM clock GROUP BY cpuid", fx.CLOCK)
def user_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.measures(fx.clock_events(spark, sf_dir), ["cpuid"], {"longest": F.max("nticks"), "threads": F.countDistinct("thrid")})


# ---- index groups ----


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sample_intervals(fx.snapshots(spark, sf_dir), ["n_events", "sum_value"])


def _with_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = fx.clock_events(spark, sf_dir)
    with_sample = intervals.first_interval(clock, _samples(spark, sf_dir).withColumn("sample", F.col("number")), ["row_id"], "tstamp", "start_ns", "end_ns", "number", "sample", DAY)
    gc = intervals.gc_pairs(fx.gc_log(spark, sf_dir)).withColumn("gc", F.col("id"))
    return intervals.first_interval(with_sample, gc, ["row_id"], "tstamp", "start_ns", "end_ns", "id", "gc", DAY // 24)


_LOOKED = """looked AS (SELECT c.*, (SELECT min(number) FROM sample_intervals s WHERE s.exp_id = c.exp_id AND c.tstamp BETWEEN s.start_ns AND s.end_ns) AS sample,
  (SELECT min(id) FROM gc g WHERE g.exp_id = c.exp_id AND c.tstamp BETWEEN g.start_ns AND g.end_ns) AS gc FROM clock c)"""
_FRAMES = (fx.CLOCK, fx.GC, fx.SNAPSHOTS, _LOOKED)


def _group_sql(key: str, label: str) -> str:
    return f"""SELECT key, {label} AS label, sum({NS})::BIGINT AS cpu_ns, count(*) AS n FROM (SELECT ({key})::BIGINT AS key, * FROM looked) GROUP BY key
UNION ALL SELECT -2, '<Total>', sum({NS})::BIGINT, count(*) FROM looked"""


def _group(name: str, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return groups.index_groups(_with_intervals(spark, sf_dir), groups.standard(), name, {"cpu_ns": F.expr(NS), "n": F.lit(1)})

    query.__name__ = f"index_{name}"
    register(sql, *_FRAMES)(query)


_group("threads", _group_sql("exp_id::BIGINT * 4294967296 + thrid", "'Process ' || (key // 4294967296) || ', Thread ' || (key % 4294967296)"))
_group("cpus", _group_sql("cpuid", "'CPU ' || key"))
_group("samples", _group_sql("coalesce(sample, -1)", "'Sample ' || CASE WHEN key < 0 THEN '18446744073709551615' ELSE key::VARCHAR END"))
_group("gc_events", _group_sql("coalesce(gc, 0)", "CASE WHEN key = 0 THEN 'Not in any GCEvent' ELSE 'GCEvent ' || key END"))
_group("seconds", _group_sql("(tstamp - start_ns) // 1000000000", "'Second ' || key"))
_group("processes", _group_sql("exp_id", "'Process ' || key"))
_group("experiment_ids", _group_sql("exp_id::BIGINT * 4294967296", "'Experiment ' || printf('0x%016x', key)"))


@register(f"""SELECT key, printf('hour 0x%016x (%d)', key, key) AS label, sum({NS})::BIGINT AS cpu_ns FROM (SELECT (tstamp - start_ns) // 3600000000000 % 24 AS key, * FROM clock) GROUP BY key
UNION ALL SELECT -2, '<Total>', sum({NS})::BIGINT FROM clock""", fx.CLOCK)
def index_user_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups.Groups()
    g.define("hour", "(tstamp - start_ns) div 3600000000000 % 24")
    return groups.index_groups(fx.clock_events(spark, sf_dir), g, "hour", {"cpu_ns": F.expr(NS)})


@register(f"SELECT coalesce(sum({NS}), 0)::BIGINT AS cpu_ns FROM clock WHERE cpuid = 3", fx.CLOCK)
def index_self_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = groups.index_groups(fx.clock_events(spark, sf_dir).withColumns({"sample": F.lit(None), "gc": F.lit(None)}), groups.standard(), "cpus", {"cpu_ns": F.expr(NS)})
    return groups.self_row(table, 3, ["cpu_ns"])


@register("""SELECT a.exp_id::BIGINT * 4294967296 + a.thrid AS key, 'Process ' || a.exp_id || ', Thread ' || a.thrid ||
 CASE WHEN any_value(j.end_ns > j.start_ns) THEN ', JThread ' || any_value(j.jthr_id) || ' ''' || any_value(j.name) || '''' ELSE '' END AS label
FROM clock a JOIN jthreads j ON j.exp_id = a.exp_id AND j.tid = a.thrid GROUP BY a.exp_id, a.thrid""", fx.CLOCK, fx.THREADS)
def thread_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.thread_labels(fx.clock_events(spark, sf_dir), intervals.thread_intervals(fx.thread_log(spark, sf_dir)))


@register("""SELECT e::BIGINT AS excl, least(i, t)::BIGINT AS incl, 100.0::DOUBLE * e / t AS excl_pct, 100.0::DOUBLE * least(i, t) / t AS incl_pct FROM (
SELECT (SELECT sum(weight) FROM samples WHERE stack[len(stack)] IN ('view', 'click')) AS e,
 (SELECT sum(weight * (list_contains(stack, 'view')::INT + list_contains(stack, 'click')::INT)) FROM samples) AS i, (SELECT sum(weight) FROM samples) AS t)""", fx.STACKS)
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.summary(stacks.function_table(fx.stacks(spark, sf_dir), "weight"), ["view", "click"])


@register(f"SELECT sum({NS})::BIGINT AS cpu_ns, count(*) AS n FROM clock", fx.CLOCK)
def totals_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.totals_row(fx.clock_events(spark, sf_dir), {"cpu_ns": F.expr(NS), "n": F.lit(1)})


@register(f"""SELECT 'cpu_sec' AS metric, sum({NS}) / 1e9 AS value FROM clock
UNION ALL SELECT unnest(['alloc_bytes', 'allocs', 'leak_bytes', 'leaks']), unnest([sum(hsize)::DOUBLE, count(*)::DOUBLE, sum(hleaked)::DOUBLE, count(CASE WHEN hleaked <> 0 THEN 1 END)::DOUBLE]) FROM matched WHERE htype NOT IN (1, 4) AND hvaddr <> 0
UNION ALL SELECT 'duration_sec', (max(tstamp) - {START}) / 1e9 FROM clock WHERE exp_id = 1
UNION ALL SELECT 'gc_sec', sum(e - s) / 1e9 FROM (SELECT greatest(start_ns, {START}) AS s, least(end_ns, (SELECT max(tstamp) FROM clock WHERE exp_id = 1)) AS e FROM gc WHERE exp_id = 1) WHERE e >= s""", fx.CLOCK, fx.HEAP, fx.GC)
def metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fx.experiments(spark, sf_dir)
    total = intervals.gc_duration(intervals.gc_clip(intervals.gc_pairs(fx.gc_log(spark, sf_dir)), runs))
    return groups.metric_tree(fx.clock_events(spark, sf_dir), heap.leak_match(fx.heap_events(spark, sf_dir)), runs.join(total, "exp_id", "left"))


@register("SELECT DISTINCT exp_id, thrid AS entity FROM clock", fx.CLOCK)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.entities([fx.clock_events(spark, sf_dir), fx.heap_events(spark, sf_dir)], "thrid")


# ---- intervals and lookups ----


@register("SELECT exp_id, id::BIGINT AS id, start_ns, end_ns FROM gc", fx.GC)
def gc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gc_pairs(fx.gc_log(spark, sf_dir))


@register(f"""SELECT exp_id, row_number() OVER (PARTITION BY exp_id ORDER BY id) AS id, s AS start_ns, e AS end_ns, e - s AS duration_ns FROM (
SELECT g.exp_id, g.id, greatest(g.start_ns, {START}) AS s, least(g.end_ns, l.last) AS e FROM gc g JOIN (SELECT exp_id, max(tstamp) AS last FROM clock GROUP BY 1) l USING (exp_id) WHERE g.end_ns >= {START} AND g.start_ns <= l.last)""", fx.CLOCK, fx.GC)
def gc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gc_table(intervals.gc_clip(intervals.gc_pairs(fx.gc_log(spark, sf_dir)), fx.experiments(spark, sf_dir)))


@register("SELECT exp_id, number::BIGINT AS row_id, end_ns AS tstamp, end_ns - start_ns AS evt_time FROM sample_intervals", fx.CLOCK, fx.SNAPSHOTS)
def sample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_events(_samples(spark, sf_dir), "number")


@register("""SELECT exp_id, number::BIGINT AS number, start_ns, end_ns, n_events, sum_value, CASE WHEN number > 1 THEN 'label-' || (number - 1) ELSE '<unknown>' END AS start_label, 'label-' || number AS end_label
FROM sample_intervals WHERE number BETWEEN 1 AND 20""", fx.CLOCK, fx.SNAPSHOTS)
def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = fx.snapshots(spark, sf_dir)
    numbers = intervals.sample_intervals(snaps, ["n_events"])
    labels = numbers.select("exp_id", "number", F.format_string("label-%d", "number").alias("label"))
    return reports.sample_table(intervals.sample_intervals(snaps, ["n_events", "sum_value"], labels), 1, 20)


@register("SELECT exp_id, rec AS id, lag(n_events::VARCHAR) OVER (PARTITION BY exp_id ORDER BY rec) AS start_label, n_events::VARCHAR AS end_label FROM snapshots", fx.CLOCK, fx.SNAPSHOTS)
def label_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.label_chain(fx.snapshots(spark, sf_dir).select("exp_id", F.col("rec").alias("id"), F.col("n_events").cast("string").alias("label")))


@register("SELECT exp_id, jthr_id::BIGINT AS jthr_id, tid, name, group_name, start_ns, end_ns FROM jthreads", fx.CLOCK, fx.THREADS)
def thread_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.thread_intervals(fx.thread_log(spark, sf_dir))


@register("SELECT c.row_id, (c.exp_id::BIGINT * 4294967296 + coalesce(j.jthr_id, 0))::BIGINT AS jthread FROM clock c LEFT JOIN jthreads j ON j.exp_id = c.exp_id AND j.tid = c.thrid AND j.start_ns <= c.tstamp AND c.tstamp < j.end_ns", fx.CLOCK, fx.THREADS)
def thread_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.thread_at(fx.clock_events(spark, sf_dir), intervals.thread_intervals(fx.thread_log(spark, sf_dir)), ["row_id"])
    return found.select("row_id", ex.thread_handle("exp_id", "jthr_id").alias("jthread"))


@register("SELECT exp_id, tid, jthr_id::BIGINT AS jthr_id, name FROM jthreads", fx.CLOCK, fx.THREADS)
def representative_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.representative_thread(intervals.thread_intervals(fx.thread_log(spark, sf_dir)))


@register("SELECT row_id, coalesce(sample, -1) AS sample, coalesce(gc, 0) AS gc FROM looked", *_FRAMES)
def interval_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_intervals(spark, sf_dir).select("row_id", F.coalesce("sample", F.lit(-1).cast("bigint")).alias("sample"), F.coalesce("gc", F.lit(0).cast("bigint")).alias("gc"))


@register("""SELECT a.l_orderkey, a.l_linenumber, a.pc, a.at_ns, arg_max(s.function_id, (s.load_ns::HUGEINT * 1000000 + s.base // 1000)) AS function_id FROM (SELECT DISTINCT * FROM addresses) a
LEFT JOIN segments s ON a.pc >= s.base AND a.pc < s.base + s.size AND s.load_ns <= a.at_ns AND a.at_ns < s.unload_ns
GROUP BY ALL""", fx.SEGMENTS, fx.ADDRESSES)
def pc_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.resolve_addresses(fx.addresses(spark, sf_dir).distinct(), fx.segments(spark, sf_dir), ["l_orderkey", "l_linenumber", "pc", "at_ns"], "pc", "at_ns")


@register("SELECT l.l_orderkey, l.l_linenumber, v.function_id FROM lookups l ASOF LEFT JOIN versions v ON l.id = v.id AND l.at_ns >= v.from_ns", fx.VERSIONS)
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.as_of(fx.lookups(spark, sf_dir), fx.method_versions(spark, sf_dir), "id", "at_ns", "from_ns", "function_id").select("l_orderkey", "l_linenumber", "function_id")


@register("""SELECT a.exp_id, CASE WHEN (a.load_ns, a.ord) < (b.load_ns, b.ord) THEN a.ord ELSE b.ord END AS a, CASE WHEN (a.load_ns, a.ord) < (b.load_ns, b.ord) THEN b.ord ELSE a.ord END AS b
FROM segments a JOIN segments b ON a.base < b.base + b.size AND b.base < a.base + a.size AND a.load_ns < b.unload_ns AND b.load_ns < a.unload_ns AND a.ord < b.ord""", fx.SEGMENTS)
def overlapping_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlapping_segments(fx.segments(spark, sf_dir))


@register("SELECT exp_id, base, load_ns, unload_ns FROM segments", fx.SEGMENTS)
def segment_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.segments(spark, sf_dir)
    log = s.select("exp_id", "base", "size", "name", F.inline(F.array(F.struct(F.lit("map").alias("kind"), F.col("load_ns").alias("tstamp"), (F.col("ord") * 2).alias("ord")), F.struct(F.lit("unmap").alias("kind"), F.col("unload_ns").alias("tstamp"), (F.col("ord") * 2 + 1).alias("ord")))))
    return intervals.drop_duplicate_segments(intervals.segment_lifetimes(log)).select("exp_id", "base", "load_ns", "unload_ns")


@register("SELECT exp_id, max(tstamp) AS last_event_ns FROM clock GROUP BY exp_id", fx.CLOCK)
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.last_event([fx.clock_events(spark, sf_dir), fx.heap_events(spark, sf_dir)])


@register("""SELECT exp_id, sum(coalesce(next, last) - tstamp)::BIGINT AS non_paused_ns FROM (
SELECT *, lead(tstamp) OVER (PARTITION BY exp_id ORDER BY row_id) AS next FROM (SELECT *, lag(kind) OVER (PARTITION BY exp_id ORDER BY row_id) AS prev FROM gc_log) WHERE prev IS DISTINCT FROM kind)
JOIN (SELECT exp_id, max(tstamp) AS last FROM clock GROUP BY 1) USING (exp_id) WHERE kind = 'start' GROUP BY exp_id""", fx.CLOCK, fx.GC)
def non_paused(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.gc_log(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "start", "resume").otherwise("pause"))
    return intervals.non_paused(log, intervals.last_event([fx.clock_events(spark, sf_dir)]))


@register("SELECT exp_id, frinfo % 97 AS frinfo, arg_min(thrid, row_id) AS thrid, arg_min(tstamp, row_id) AS tstamp FROM clock GROUP BY exp_id, frinfo % 97", fx.CLOCK)
def stack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.stack_context([fx.clock_events(spark, sf_dir).withColumn("frinfo", F.col("frinfo") % 97)])


@register("SELECT exp_id, thrid, row_number() OVER (PARTITION BY exp_id ORDER BY min(row_id)) AS n FROM clock GROUP BY exp_id, thrid", fx.CLOCK)
def dense_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.densify(fx.clock_events(spark, sf_dir), "thrid", "row_id", "n").select("exp_id", "thrid", F.col("n").cast("bigint").alias("n")).distinct()


@register("SELECT c.row_id, coalesce(array_to_string(s.stack, '/'), '<Unknown>') AS stack FROM clock c LEFT JOIN samples s ON s.exp_id = c.exp_id AND s.frinfo = c.frinfo AND s.frinfo % 5 <> 0", fx.CLOCK, fx.STACKS)
def attached_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = fx.stacks(spark, sf_dir).where("frinfo % 5 <> 0")
    return intervals.attach_stacks(fx.clock_events(spark, sf_dir), some).select("row_id", F.array_join("stack", "/").alias("stack"))


@register("""SELECT s.row_id, CASE WHEN coalesce(j.jthr_id, 0) = 0 AND s.row_id % 3 <> 0 OR coalesce(j.group_name = 'system', FALSE) THEN '<JVM-System>'
 WHEN s.row_id % 3 = 0 THEN array_to_string(s.stack, '/') ELSE 'native' END AS stack
FROM samples s LEFT JOIN jthreads j ON j.exp_id = s.exp_id AND j.tid = s.thrid AND j.start_ns <= s.tstamp AND s.tstamp < j.end_ns""", fx.CLOCK, fx.STACKS, fx.THREADS)
def resolved_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = intervals.thread_intervals(fx.thread_log(spark, sf_dir))
    rows = intervals.thread_at(fx.stacks(spark, sf_dir), threads, ["row_id"]).join(threads.select("exp_id", "jthr_id", "group_name"), ["exp_id", "jthr_id"], "left")
    rows = rows.select("row_id", "jthr_id", "group_name", F.when(F.col("row_id") % 3 == 0, F.col("stack")).alias("java"), F.array(F.lit("native")).alias("native"))
    return intervals.resolve_stacks(rows).select("row_id", F.array_join("stack", "/").alias("stack"))


@register("SELECT l_orderkey, l_linenumber, coalesce(p_name, '<Unknown>') AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fx.segments(spark, sf_dir).select("function_id", "name")
    rows = fx._read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("function_id"))
    return intervals.names_of(rows, names).select("l_orderkey", "l_linenumber", "name")


# ---- timeline ----

_IN = f"tstamp >= {START} AND tstamp < {START + BINS * DAY}"


@register(f"SELECT exp_id, (tstamp - {START}) // {DAY} AS bin, count(*) AS value FROM clock WHERE {_IN} GROUP BY ALL", fx.CLOCK)
def timeline_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.binned(fx.clock_events(spark, sf_dir), START, DAY, BINS, lane=["exp_id"])


@register(f"SELECT (greatest(tstamp - evt_time, {START}) - {START}) // {DAY // 24} AS bin, sum(nticks)::BIGINT AS value FROM clock WHERE {_IN} GROUP BY ALL", fx.CLOCK)
def timeline_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.binned(fx.clock_events(spark, sf_dir), START, DAY // 24, BINS * 24, F.col("nticks"), durations=True)


@register(f"SELECT e.exp_id, b AS bin, coalesce(n, 0)::BIGINT AS value FROM (SELECT DISTINCT exp_id FROM clock) e CROSS JOIN range(0, {BINS * 24}) r(b) LEFT JOIN (SELECT exp_id, (tstamp - {START}) // {DAY // 24} AS bin, count(*) AS n FROM clock WHERE {_IN} GROUP BY ALL) c ON c.exp_id = e.exp_id AND c.bin = b", fx.CLOCK)
def timeline_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.binned(fx.clock_events(spark, sf_dir), START, DAY // 24, BINS * 24, lane=["exp_id"], dense=True)


_W = 250_000_000
_SPREAD_SQL = f"""SELECT bin, state, sum(CASE WHEN lo = hi OR (bin > lo AND bin < hi) THEN trunc(share)
  WHEN bin = lo THEN trunc(CASE WHEN f < {START} + bin * {_W} THEN share ELSE share * (({START} + bin * {_W} + {_W - 1} - f)::DOUBLE / {_W}) END)
  ELSE trunc(CASE WHEN t > {START} + bin * {_W} + {_W - 1} THEN share ELSE share * ((t - {START} - bin * {_W})::DOUBLE / {_W}) END) END)::BIGINT AS value
FROM (SELECT *, unnest(range(lo, hi + 1)) AS bin FROM (SELECT *, CASE WHEN lo = hi THEN w::DOUBLE ELSE w / (dur::DOUBLE / {_W}) END AS share FROM (
  SELECT mstate AS state, {NS} AS w, evt_time AS dur, tstamp - evt_time AS f, tstamp AS t, (greatest(tstamp - evt_time, {START}) - {START}) // {_W} AS lo, (tstamp - {START}) // {_W} AS hi FROM clock WHERE {_IN})))
GROUP BY ALL"""


@register(_SPREAD_SQL, fx.CLOCK)
def timeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.state_spread(fx.clock_events(spark, sf_dir), START, _W, BINS * DAY // _W, weight=F.expr(NS))


@register(f"""SELECT e.exp_id, b AS bin, coalesce(top, (SELECT arg_max(s.cur_allocs, (s.tstamp, s.row_id)) FROM size s WHERE s.exp_id = e.exp_id AND s.tstamp < {START + 5 * DAY} + b * {DAY // 8}), 0)::BIGINT AS value
FROM (SELECT DISTINCT exp_id FROM size) e CROSS JOIN range(0, 80) r(b) LEFT JOIN (
  SELECT exp_id, bin, CASE WHEN bool_or(prior) THEN max(v) ELSE greatest(max(v), 0) END AS top FROM (
    SELECT exp_id, (tstamp - {START + 5 * DAY}) // {DAY // 8} AS bin, cur_allocs AS v, FALSE AS prior FROM size WHERE tstamp >= {START + 5 * DAY} AND tstamp < {START + 15 * DAY}
    UNION ALL SELECT exp_id, 0, arg_max(cur_allocs, (tstamp, row_id)), TRUE FROM size WHERE tstamp < {START + 5 * DAY} GROUP BY exp_id) GROUP BY ALL) c ON c.exp_id = e.exp_id AND c.bin = b""", fx.HEAP, f"size AS ({_size_sql('TRUE')})")
def timeline_highwater(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = heap.heap_size(heap.leak_match(fx.heap_events(spark, sf_dir)))
    return timeline.high_water(size, "cur_allocs", START + 5 * DAY, DAY // 8, 80)


_REPS = f"""reps AS (SELECT exp_id, (greatest(tstamp - evt_time, {START}) - {START}) // {DAY} AS bin, max_by((row_id, tstamp, evt_time), (tstamp, row_id)) AS e FROM clock WHERE {_IN} GROUP BY ALL),
rep AS (SELECT exp_id, bin, e[1] AS row_id, e[2] AS tstamp, e[3] AS evt_time FROM reps)""".replace("max_by((row_id, tstamp, evt_time)", "max_by([row_id, tstamp, evt_time]")


@register("SELECT * FROM rep", fx.CLOCK, _REPS)
def timeline_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.representatives(fx.clock_events(spark, sf_dir), START, DAY, BINS, reverse=True)


@register("SELECT * EXCLUDE (least) FROM (SELECT *, min(tstamp - evt_time) OVER (PARTITION BY exp_id ORDER BY tstamp DESC, row_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM rep) WHERE least IS NULL OR tstamp - evt_time < least", fx.CLOCK, _REPS)
def timeline_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.prune_hidden(timeline.representatives(fx.clock_events(spark, sf_dir), START, DAY, BINS, reverse=True))


@register(f"""SELECT exp_id, row_id, first AS start_bin, end_bin - first + 1 AS n_bins, tstamp - evt_time AS time_start, tstamp AS time_end FROM (
SELECT *, greatest((tstamp - evt_time - {START}) // {DAY}, coalesce(lag(end_bin) OVER (PARTITION BY exp_id ORDER BY tstamp, row_id), -1) + 1) AS first FROM (SELECT *, least((tstamp - {START}) // {DAY}, {BINS - 1}) AS end_bin FROM rep))""", fx.CLOCK, _REPS)
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = timeline.representatives(fx.clock_events(spark, sf_dir), START, DAY, BINS, reverse=True)
    return timeline.representative_rows(reps, START, DAY, BINS, durations=True)


_AT = START + 10 * DAY + 12345


@register(f"""SELECT l.exp_id, CASE WHEN {_AT} - l.t <= r.t - r.d - {_AT} THEN l.id ELSE r.id END AS row_id, CASE WHEN {_AT} - l.t <= r.t - r.d - {_AT} THEN l.t ELSE r.t END AS tstamp
FROM (SELECT exp_id, max(tstamp) AS t, arg_max(row_id, tstamp) AS id FROM clock WHERE tstamp < {_AT} GROUP BY 1) l
JOIN (SELECT exp_id, min(tstamp) AS t, arg_min(row_id, tstamp) AS id, arg_min(evt_time, tstamp) AS d FROM clock WHERE tstamp >= {_AT} GROUP BY 1) r USING (exp_id)""", fx.CLOCK)
def timeline_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.nearest(fx.clock_events(spark, sf_dir), _AT)


@register(f"SELECT exp_id, arg_max(row_id, tstamp) AS row_id, max(tstamp) AS tstamp FROM clock WHERE tstamp < {_AT} GROUP BY exp_id", fx.CLOCK)
def timeline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.lookup(fx.clock_events(spark, sf_dir), _AT, "<")


_PROBES = "probes AS (SELECT row_id AS probe, exp_id, tstamp + (row_id * 7919 % 86400) * 1000000000 AS at FROM clock)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time for each event, up to a day after it."""
    return fx.clock_events(spark, sf_dir).selectExpr("row_id AS probe", "exp_id", "tstamp + (row_id * 7919 % 86400) * 1000000000 AS at")


@register("SELECT probe, p.exp_id, p.at, c.row_id, c.tstamp FROM probes p ASOF LEFT JOIN clock c ON p.exp_id = c.exp_id AND p.at <= c.tstamp", fx.CLOCK, _PROBES)
def timeline_lookup_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.lookup_all(_probes(spark, sf_dir), fx.clock_events(spark, sf_dir), ">=")


@register("""SELECT probe, exp_id, "at", CASE WHEN lt IS NULL OR "at" - lt > rt - rd - "at" THEN rid ELSE lid END AS row_id, CASE WHEN lt IS NULL OR "at" - lt > rt - rd - "at" THEN rt ELSE lt END AS tstamp FROM (
  SELECT l.*, r.row_id AS rid, r.tstamp AS rt, r.evt_time AS rd FROM (SELECT p.probe, p.exp_id, p."at", c.row_id AS lid, c.tstamp AS lt FROM probes p ASOF LEFT JOIN clock c ON p.exp_id = c.exp_id AND p.at > c.tstamp) l
  ASOF LEFT JOIN clock r ON l.exp_id = r.exp_id AND l."at" <= r.tstamp)""", fx.CLOCK, _PROBES)
def timeline_nearest_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.nearest_all(_probes(spark, sf_dir), fx.clock_events(spark, sf_dir))


@register("SELECT exp_id, thrid, row_id, lead(row_id, 3) OVER w AS to_row, lead(tstamp - evt_time // 2, 3) OVER w AS center FROM clock WINDOW w AS (PARTITION BY exp_id, thrid ORDER BY tstamp, row_id)", fx.CLOCK)
def timeline_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.step(fx.clock_events(spark, sf_dir), 3, ["exp_id", "thrid"])


@register("SELECT exp_id, row_id, tstamp, cpuid FROM clock WHERE exp_id = 2 AND cpuid = 1", fx.CLOCK)
def timeline_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.select_events(fx.clock_events(spark, sf_dir), 2, "cpuid", 1).select("exp_id", "row_id", "tstamp", "cpuid")


@register("SELECT exp_id, cpuid::BIGINT AS entity, count(*) AS n FROM clock GROUP BY ALL", fx.CLOCK)
def timeline_has_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.has_data(fx.clock_events(spark, sf_dir), "cpuid")


@register("SELECT c.row_id, c.tstamp, array_to_string(s.stack, '/') AS stack, CASE c.mstate WHEN 0 THEN 'user' WHEN 1 THEN 'system' WHEN 2 THEN 'trap' WHEN 7 THEN 'sleep' WHEN 10 THEN 'linux' END AS state FROM clock c JOIN samples s ON s.exp_id = c.exp_id AND s.frinfo = c.frinfo WHERE c.row_id IN (5, 50, 500)", fx.CLOCK, fx.STACKS)
def event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = spark.createDataFrame(list(metrics.STATES.items()), "value int, name string")
    found = timeline.event_detail(fx.clock_events(spark, sf_dir), fx.stacks(spark, sf_dir).select("exp_id", "frinfo", "stack"), states, [5, 50, 500])
    return found.select("row_id", "tstamp", F.array_join("stack", "/").alias("stack"), "state")


# ---- sorting, reports, functions ----


@register("""SELECT function, excl, incl FROM (SELECT function, sum(CASE WHEN function = stack[len(stack)] THEN weight ELSE 0 END)::BIGINT AS excl, sum(weight)::BIGINT AS incl
FROM (SELECT stack, weight, unnest(list_distinct(stack)) AS function FROM samples) GROUP BY function UNION ALL SELECT '<Total>', sum(weight)::BIGINT, sum(weight)::BIGINT FROM samples)
ORDER BY function <> '<Total>', excl DESC, function LIMIT 4""", fx.STACKS)
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.text_report(stacks.function_table(fx.stacks(spark, sf_dir), "weight"), "excl", 4)


@register("SELECT row_id, exp_id, cpuid, thrid FROM clock ORDER BY cpuid, thrid, row_id LIMIT 100", fx.CLOCK)
def sorted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sorting.sort_events(fx.clock_events(spark, sf_dir), ["cpuid", "absent", "thrid"])
    return sorting.limited(rows, 100).select("row_id", "exp_id", "cpuid", "thrid")


@register("SELECT exp_id, row_id, mstate, NULL::INTEGER AS htype FROM clock UNION ALL SELECT exp_id, row_id, NULL, htype FROM heap", fx.CLOCK, fx.HEAP)
def union_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.union_all([fx.clock_events(spark, sf_dir).select("exp_id", "row_id", "mstate"), fx.heap_events(spark, sf_dir).select("exp_id", "row_id", "htype")])


@register("SELECT exp_id, 0 AS state, 'Experiment: ' || path || '; Host: ' || hostname || '; Processes: ' || pid AS info FROM experiments", fx.CLOCK, fx.EXPERIMENTS)
def experiment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.experiment_report(fx.experiments(spark, sf_dir))


@register("SELECT exp_id, start_ns, last_event_ns AS end_ns, (last_event_ns - start_ns) / 1e9 AS wall_sec, clock_mhz FROM experiments", fx.CLOCK, fx.EXPERIMENTS)
def time_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.time_info(fx.experiments(spark, sf_dir))


@register("SELECT p_partkey AS obj_id, p_name AS name, p_size * 40 AS size FROM part WHERE p_partkey % 2 = 0")
def load_object_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.segments(spark, sf_dir).select(F.col("function_id").alias("obj_id"), "name", F.col("size").cast("int").alias("size"), F.when(F.col("function_id") % 2 == 0, "TEXT").otherwise("DATA").alias("type"))
    return reports.load_object_list(rows)


def _catalogue(kind: str, columns: str, states: str) -> str:
    """SQL of one table's part, for columns written as name:type."""
    each = [c.split(":") for c in columns.split()]
    parts = (f"SELECT '{kind}' AS kind, '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows, count({c}) AS n_present, {f'count(DISTINCT {c})' if c == states else '0::BIGINT'} AS n_states FROM {kind}" for c, t in each)
    return "\nUNION ALL ".join(parts)


_CATALOGUE = [
    _catalogue("clock", "row_id:bigint exp_id:int tstamp:bigint thrid:bigint cpuid:int mstate:int nticks:bigint value:double start_ns:bigint ptimer_usec:bigint", "mstate"),
    _catalogue("heap", "exp_id:int row_id:bigint tstamp:bigint thrid:bigint htype:int hvaddr:bigint hovaddr:bigint hsize:bigint", "htype"),
]


@register("\nUNION ALL ".join(_CATALOGUE), fx.CLOCK, fx.HEAP)
def column_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.column_catalogue({"clock": fx.clock_events(spark, sf_dir), "heap": fx.heap_events(spark, sf_dir)}, ("mstate", "htype"))


_SHOWN = " ".join(f"WHEN {code} THEN '{shown}'" for code, _, shown in ingest.DEFAULT_STATES)


@register(f"SELECT row_id, mstate, CASE mstate {_SHOWN} END AS mstate_name FROM clock", fx.CLOCK)
def labelled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.clock_events(spark, sf_dir).select("row_id", F.col("exp_id").alias("experiment"), "mstate")
    return ingest.label_states(rows, None, "mstate").select("row_id", "mstate", "mstate_name")


@register("""SELECT exp_id, kind, count(*) AS n, string_agg(said, '|' ORDER BY event_id) AS texts
FROM (SELECT 1 + event_id % 3 AS exp_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'comment' END AS kind, 'm' || event_id AS said
  FROM events WHERE event_type IN ('error', 'signup', 'purchase')) GROUP BY ALL""")
def messages_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx._read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "cerror").when(F.col("event_type") == "signup", "cwarn").when(F.col("event_type") == "purchase", "comment").otherwise("sample")
    attributes = F.create_map(F.lit("kind"), kind, F.lit("id"), F.col("event_id").cast("string"), F.lit("ec"), F.lit("0"))
    elements = e.select((F.col("event_id") % 3 + 1).alias("experiment"), F.lit("event").alias("element"), attributes.alias("attributes"), F.concat(F.lit("m"), "event_id").alias("text"), F.col("event_id").alias("ord"))
    found = ingest.messages_by_run(ingest.messages(elements))
    return found.select(F.col("experiment").alias("exp_id"), "kind", "n", F.array_join("texts", "|").alias("texts"))


@register("""SELECT row_id, h.exp_id, pid, CASE WHEN h.exp_id = 2 THEN NULL ELSE 2000 END AS freq_mhz, hsize AS io_or_heap, -hsize AS below,
  (hsize <> hvaddr)::BIGINT AS other, hovaddr || ',' || hvaddr AS listed FROM heap h JOIN experiments USING (exp_id)""", fx.CLOCK, fx.EXPERIMENTS, fx.HEAP)
def run_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.heap_events(spark, sf_dir).join(fx.experiments(spark, sf_dir).select("exp_id", "pid", F.when(F.col("exp_id") == 2, 0).otherwise(F.col("clock_mhz")).alias("mhz")), "exp_id")
    listed = F.array_join(F.transform(ex.listed(F.col("hvaddr"), F.col("hovaddr")), lambda x: x.cast("string")), ",")
    return rows.select("row_id", "exp_id", "pid", ex.freq_mhz(F.col("mhz")).alias("freq_mhz"), ex.io_or_heap_bytes(rows).alias("io_or_heap"), ex.negative(F.col("hsize")).alias("below"), ex.differs(F.col("hsize"), F.col("hvaddr")).alias("other"), listed.alias("listed"))


_METRICS = "SELECT function, sum(CASE WHEN function = stack[len(stack)] THEN weight ELSE 0 END)::BIGINT AS e_cpu{} FROM (SELECT stack, weight, unnest(list_distinct(stack)) AS function FROM samples) GROUP BY function"


def _function_metrics(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    totals = stacks.function_table(fx.stacks(spark, sf_dir), "weight").where(F.col("function") != stacks.TOTAL)
    return metrics.project(totals.withColumnsRenamed({"excl": "e_cpu", "incl": "i_cpu"}), ["cpu", "absent"], table, ["function"])


@register(_METRICS.format(", sum(weight)::BIGINT AS i_cpu"), fx.STACKS)
def metrics_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _function_metrics(spark, sf_dir, "normal")


@register(_METRICS.format(""), fx.STACKS)
def metrics_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _function_metrics(spark, sf_dir, "index")


_CALLS = """edges AS (SELECT stack[d] AS caller, stack[d + 1] AS function, weight FROM (SELECT stack, weight, unnest(range(1, len(stack))) AS d FROM samples)),
sums AS (SELECT function, sum(weight)::BIGINT AS i_cpu, sum(CASE WHEN function = stack[len(stack)] THEN weight ELSE 0 END)::BIGINT AS e_cpu FROM (SELECT stack, weight, unnest(list_distinct(stack)) AS function FROM samples) GROUP BY 1),
called AS (SELECT p[d] AS neighbour, sum(CASE WHEN d = last THEN w ELSE 0 END)::BIGINT AS a_cpu FROM each_hit WHERE d >= 1 GROUP BY 1)"""


def _call_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The callers of one function with their own sums."""
    samples = fx.stacks(spark, sf_dir)
    called = stacks.callers(samples, ["view"], "weight").withColumnsRenamed({"neighbour": "function", "attributed": "a_cpu"})
    totals = stacks.function_table(samples, "weight").withColumnsRenamed({"excl": "e_cpu", "incl": "i_cpu"})
    return called.join(totals, "function")


@register("SELECT neighbour AS function, a_cpu, coalesce(e_cpu, total) AS e_cpu, coalesce(i_cpu, total) AS i_cpu FROM called LEFT JOIN sums ON neighbour = function, (SELECT sum(weight)::BIGINT AS total FROM samples)", fx.STACKS, _MATCH, _CALLS)
def metrics_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.project(_call_table(spark, sf_dir), ["cpu"], "call", ["function"])


@register("SELECT neighbour AS function, a_cpu FROM called", fx.STACKS, _MATCH, _CALLS)
def metrics_call_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.project(_call_table(spark, sf_dir), ["cpu"], "call", ["function"], hidden=False)


@register("SELECT thrid, sum(hsize)::BIGINT AS e_bytes, count(*) AS e_allocs FROM heap WHERE htype = 0 GROUP BY thrid", fx.HEAP)
def metrics_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.heap_events(spark, sf_dir)
    sums = rows.where("htype = 0").groupBy("thrid").agg(F.sum("hsize").alias("e_bytes"), F.sum("hsize").alias("i_bytes"), F.count("*").alias("e_allocs"), F.max("tstamp").alias("e_cpu"))
    return metrics.project(sums, ["bytes", "allocs", "cpu"], "heap", ["thrid"], {"bytes": "heap", "allocs": "heap", "cpu": "clock"})


@register("""SELECT p_partkey, p_name || coalesce(CASE WHEN p_partkey % 11 <> 0 THEN '(' || CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'java.lang.String' WHEN 2 THEN 'double' ELSE 'boolean' END || repeat('[]', p_size % 3) || ', long' || ')' END, '') AS method FROM part""")
def method_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx._read(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("I", "Ljava/lang/String;", "D", "Z"))), (F.col("p_size") % 4 + 1).cast("int"))
    # every eleventh is no descriptor
    last = F.when(F.col("p_partkey") % 11 == 0, "Q").otherwise("J")
    descriptor = F.concat(F.lit("("), F.repeat(F.lit("["), (F.col("p_size") % 3).cast("int")), kind, last, F.lit(")V"))
    return part.select("p_partkey", text.method_name(F.col("p_name"), descriptor).alias("method"))


@register("""SELECT event_id, (event_id % 1000) * 1000000000 + event_id % 77 AS ns, (event_id * 31)::BIGINT AS hex_value, CASE WHEN event_id % 5 = 0 THEN '0.' ELSE printf('%.3f', (event_id % 5)::DOUBLE) END AS shown, 'pkg.sub.' || event_type AS dotted FROM events""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx._read(spark, sf_dir, "events")
    return e.select("event_id", text.time_ns(F.concat_ws(".", F.col("event_id") % 1000, F.col("event_id") % 77)).alias("ns"), text.c_number(F.concat(F.lit("0x"), F.lower(F.hex(F.col("event_id") * 31)))).alias("hex_value"), text.shown_number((F.col("event_id") % 5).cast("double")).alias("shown"), text.dotted_name(F.concat(F.lit("Lpkg/sub/"), F.col("event_type"), F.lit(";"))).alias("dotted"))


@register("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sum(CAST(floor(value) AS BIGINT))::BIGINT AS total FROM events GROUP BY ALL")
def windowed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx._read(spark, sf_dir, "events")
    return streamed_bins(e, "ts", "1 day", "1 hour", ["event_type"], {"total": F.floor("value")}).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@register("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sum(CAST(floor(value) AS BIGINT))::BIGINT AS total FROM events GROUP BY ALL")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bins from a stream of the events in four micro-batches, late rows
    put aside and counted at the end."""
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    events = fx._read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4, "event_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    writer = store_bins(stream, f"{root}/out", "ts", "1 day", "1 hour", ["event_type"], {"total": F.floor("value")})
    writer.trigger(availableNow=True).start().awaitTermination()
    found = stored_bins(spark, f"{root}/out", ["event_type"], ["total"], late=True)
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


from stackloom import recorded  # noqa: E402, F401  (registers its queries)
