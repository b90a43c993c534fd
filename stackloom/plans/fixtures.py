"""Profile-event tables made from the relational test data, and the same as SQL.

Every frame has a Spark form and a text of common table expressions with the
same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START_NS = 1_704_067_200_000_000_000  # 2024-01-01 UTC
PTIMER_USEC = 10_000
DAY_NS = 86_400_000_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ns(column: str) -> str:
    # both sides are read in the session's zone, so that it drops out
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ)) * 1000"


def clock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id AS row_id",
        "CAST(1 + event_id % 3 AS INT) AS exp_id",
        f"{_ns('ts')} AS tstamp",
        "user_id AS thrid",
        "CAST(user_id % 4 AS INT) AS cpuid",
        "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 7 WHEN 'error' THEN 10 END AS mstate",
        "1 + event_id % 3 AS nticks",
        "(event_id % 4) * 1000000000 AS evt_time",
        "event_id AS frinfo",
        "value",
        f"CAST({START_NS} AS BIGINT) AS start_ns",
        f"CAST({PTIMER_USEC} AS BIGINT) AS ptimer_usec",
    )


CLOCK = f"""clock AS (
  SELECT event_id AS row_id, CAST(1 + event_id % 3 AS INTEGER) AS exp_id, epoch_us(ts) * 1000 AS tstamp, user_id AS thrid,
    CAST(user_id % 4 AS INTEGER) AS cpuid,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 7 WHEN 'error' THEN 10 END AS mstate,
    1 + event_id % 3 AS nticks, (event_id % 4) * 1000000000 AS evt_time, event_id AS frinfo, value,
    CAST({START_NS} AS BIGINT) AS start_ns, CAST({PTIMER_USEC} AS BIGINT) AS ptimer_usec
  FROM events)"""


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exp_id, row_id, frinfo, stack, weight, thrid, tstamp): the types of the
    last five events of the user, the current one the leaf."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    rows = _read(spark, sf_dir, "events").withColumn("stack", F.collect_list("event_type").over(w))
    return rows.selectExpr("CAST(1 + event_id % 3 AS INT) AS exp_id", "event_id AS row_id", "event_id AS frinfo", "stack", f"(1 + event_id % 3) * {PTIMER_USEC} * 1000 AS weight", "user_id AS thrid", f"{_ns('ts')} AS tstamp")


STACKS = f"""samples AS (
  SELECT CAST(1 + event_id % 3 AS INTEGER) AS exp_id, event_id AS row_id, event_id AS frinfo,
    list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS stack,
    (1 + event_id % 3) * {PTIMER_USEC} * 1000 AS weight, user_id AS thrid, epoch_us(ts) * 1000 AS tstamp
  FROM events)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, stack, weight) of line items: region, nation, segment, priority
    and return flag. Dimension tables are small; the others join on keys."""
    t = {n: _read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.array("r_name", "n_name", "c_mktsegment", "o_orderpriority", "l_returnflag").alias("stack"), F.col("l_quantity").cast("bigint").alias("weight"))


PATHS = """paths AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, [r_name, n_name, c_mktsegment, o_orderpriority, l_returnflag] AS stack,
    CAST(floor(l_quantity) AS BIGINT) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def heap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("CAST(1 + event_id % 3 AS INT) AS exp_id", "event_id AS row_id", f"{_ns('ts')} AS tstamp", "user_id AS thrid", "CAST(event_id % 5 AS INT) AS htype", "(event_id * 7919 % 10007) % 89 AS hvaddr", "(event_id * 104729 % 10007) % 89 AS hovaddr", "CAST(floor(value * 100) AS BIGINT) AS hsize")


HEAP = """heap AS (
  SELECT CAST(1 + event_id % 3 AS INTEGER) AS exp_id, event_id AS row_id, epoch_us(ts) * 1000 AS tstamp, user_id AS thrid,
    CAST(event_id % 5 AS INTEGER) AS htype, (event_id * 7919 % 10007) % 89 AS hvaddr, (event_id * 104729 % 10007) % 89 AS hovaddr,
    CAST(floor(value * 100) AS BIGINT) AS hsize
  FROM events),
touches AS (
  SELECT exp_id, row_id, tstamp, hvaddr AS addr, 0 AS seq, htype IN (1, 4) AS release FROM heap WHERE hvaddr <> 0
  UNION ALL SELECT exp_id, row_id, tstamp, hovaddr, 1, TRUE FROM heap WHERE htype = 2 AND hovaddr <> 0),
nexts AS (
  SELECT exp_id, row_id, release, lead(row_id) OVER w AS next_row, lead(release) OVER w AS next_release
  FROM touches WINDOW w AS (PARTITION BY exp_id, addr ORDER BY tstamp, row_id, seq)),
matched AS (
  SELECT h.*, CASE WHEN htype IN (0, 2, 3) AND n.next_row IS NULL THEN hsize ELSE 0 END AS hleaked, coalesce(n.next_row + 1, 0) AS link_row
  FROM heap h LEFT JOIN (SELECT * FROM nexts WHERE NOT release AND next_release) n USING (exp_id, row_id))"""


def gc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where("event_type IN ('signup', 'error')").selectExpr("CAST(1 + event_id % 3 AS INT) AS exp_id", "event_id AS row_id", f"{_ns('ts')} AS tstamp", "CASE event_type WHEN 'signup' THEN 'start' ELSE 'end' END AS kind")


GC = """gc_log AS (
  SELECT CAST(1 + event_id % 3 AS INTEGER) AS exp_id, event_id AS row_id, epoch_us(ts) * 1000 AS tstamp,
    CASE event_type WHEN 'signup' THEN 'start' ELSE 'end' END AS kind
  FROM events WHERE event_type IN ('signup', 'error')),
gc_open AS (
  SELECT *, kind = 'start' AND coalesce(lag(kind) OVER (PARTITION BY exp_id ORDER BY row_id), 'end') = 'end' AS opens FROM gc_log),
gc_island AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY exp_id ORDER BY row_id) AS island FROM gc_open),
gc AS (
  SELECT exp_id, row_number() OVER (PARTITION BY exp_id ORDER BY island) AS id,
    CASE WHEN island = 0 THEN 0 ELSE min(CASE WHEN opens THEN tstamp END) END AS start_ns,
    coalesce(arg_max(CASE WHEN kind = 'end' THEN tstamp END, CASE WHEN kind = 'end' THEN row_id END), 9223372036854775807) AS end_ns
  FROM gc_island GROUP BY exp_id, island)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run and day: running count and whole running value."""
    per = clock_events(spark, sf_dir).groupBy("exp_id", F.expr(f"tstamp div {DAY_NS}").alias("rec")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("v"))
    w = Window.partitionBy("exp_id").orderBy("rec").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("exp_id", "rec", ((F.col("rec") + 1) * DAY_NS - 1).alias("tstamp"), F.sum("n").over(w).alias("n_events"), F.sum("v").over(w).alias("sum_value"))


SNAPSHOTS = f"""snapshots AS (
  SELECT exp_id, rec, (rec + 1) * {DAY_NS} - 1 AS tstamp, CAST(sum(n) OVER w AS BIGINT) AS n_events, CAST(sum(v) OVER w AS BIGINT) AS sum_value
  FROM (SELECT exp_id, tstamp // {DAY_NS} AS rec, count(*) AS n, sum(CAST(floor(value) AS BIGINT)) AS v FROM clock GROUP BY ALL)
  WINDOW w AS (PARTITION BY exp_id ORDER BY rec)),
sample_intervals AS (
  SELECT * FROM (
    SELECT exp_id, row_number() OVER w - 1 AS number, lag(tstamp) OVER w + 1 AS start_ns, tstamp AS end_ns,
      n_events - lag(n_events) OVER w AS n_events, sum_value - lag(sum_value) OVER w AS sum_value
    FROM snapshots WINDOW w AS (PARTITION BY exp_id ORDER BY rec))
  WHERE number > 0)"""


def thread_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start with a user's first event in a run, an end with the last."""
    per = clock_events(spark, sf_dir).groupBy("exp_id", F.col("thrid").alias("tid")).agg(F.min("tstamp").alias("lo"), F.max("tstamp").alias("hi"), F.min("row_id").alias("first"))
    edge = F.array(F.struct(F.lit("start").alias("kind"), F.col("lo").alias("tstamp"), (F.col("first") * 2).alias("row_id")), F.struct(F.lit("end").alias("kind"), F.col("hi").alias("tstamp"), (F.col("first") * 2 + 1).alias("row_id")))
    return per.select("exp_id", "tid", F.format_string("user-%d", "tid").alias("name"), F.when(F.col("tid") % 10 == 0, "system").otherwise("main").alias("group_name"), F.inline(edge))


THREADS = """jthreads AS (
  SELECT exp_id, row_number() OVER (PARTITION BY exp_id ORDER BY min(row_id)) AS jthr_id, thrid AS tid, 'user-' || thrid AS name,
    CASE WHEN thrid % 10 = 0 THEN 'system' ELSE 'main' END AS group_name, min(tstamp) AS start_ns, max(tstamp) AS end_ns
  FROM clock GROUP BY exp_id, thrid)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(788_918_400_000_000_000) + (F.col("p_partkey") % 900) * DAY_NS  # from 1995-01-01
    return _read(spark, sf_dir, "part").select(F.lit(1).alias("exp_id"), (F.col("p_partkey") * 1000).alias("base"), (F.col("p_size") * 40).cast("bigint").alias("size"), day.alias("load_ns"), (day + 1095 * DAY_NS).alias("unload_ns"), F.col("p_partkey").alias("function_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))


SEGMENTS = f"""segments AS (
  SELECT 1 AS exp_id, p_partkey * 1000 AS base, CAST(p_size * 40 AS BIGINT) AS size,
    788918400000000000 + (p_partkey % 900) * {DAY_NS} AS load_ns, 788918400000000000 + (p_partkey % 900 + 1095) * {DAY_NS} AS unload_ns,
    p_partkey AS function_id, p_partkey AS ord, p_name AS name
  FROM part)"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey * 1000 + CAST(floor(l_quantity) AS BIGINT) * 20 AS pc", f"{_ns('l_shipdate')} AS at_ns")


ADDRESSES = """addresses AS (
  SELECT l_orderkey, l_linenumber, l_partkey * 1000 + CAST(floor(l_quantity) AS BIGINT) * 20 AS pc, epoch_us(l_shipdate) * 1000 AS at_ns FROM lineitem)"""


def method_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr("o_custkey AS id", f"{_ns('o_orderdate')} AS from_ns", "o_orderkey AS function_id")


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.selectExpr("l_orderkey", "l_linenumber", "o_custkey AS id", f"{_ns('l_shipdate')} AS at_ns")


VERSIONS = """versions AS (
  SELECT o_custkey AS id, epoch_us(o_orderdate) * 1000 AS from_ns, max(o_orderkey) AS function_id FROM orders GROUP BY ALL),
lookups AS (
  SELECT l_orderkey, l_linenumber, o_custkey AS id, epoch_us(l_shipdate) * 1000 AS at_ns FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run, with what its events say of it."""
    per = clock_events(spark, sf_dir).groupBy("exp_id").agg(F.max("tstamp").alias("last_event_ns"), F.countDistinct("cpuid").alias("ncpus"))
    return per.select("exp_id", F.format_string("run.%d.er", "exp_id").alias("path"), (F.col("exp_id") + 100).alias("pid"), F.format_string("host%d", "exp_id").alias("hostname"), "ncpus", F.lit(2000).alias("clock_mhz"), F.lit(START_NS).alias("start_ns"), "last_event_ns", F.lit(PTIMER_USEC).alias("ptimer_usec"))


EXPERIMENTS = f"""experiments AS (
  SELECT exp_id, 'run.' || exp_id || '.er' AS path, exp_id + 100 AS pid, 'host' || exp_id AS hostname, count(DISTINCT cpuid) AS ncpus,
    2000 AS clock_mhz, {START_NS} AS start_ns, max(tstamp) AS last_event_ns, {PTIMER_USEC} AS ptimer_usec
  FROM clock GROUP BY exp_id)"""
