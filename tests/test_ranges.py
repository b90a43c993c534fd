"""Running values, joins of boxes, tries and probe tables against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stackloom.operators import boxes, intervals, ranges, stacks, timeline


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scan_equals_brute_force_for_hot_and_null_keys(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, 1, 1, 1, 2, *range(10, 40)]), i, draw.choice([None, *range(-9, 9)])) for i in draw.sample(range(10_000), 3_000)]
    df = frame(spark, rows, "k long, t long, v long")
    made = {"sum": ranges.Over("total", F.col("v")), "low": ranges.Over("least", F.col("v"), before=True), "last": ranges.Over("latest", F.col("v")), "prior": ranges.Over("latest", F.col("v"), before=True)}
    got = {(r.k, r.t): (r.sum, r.low, r["last"], r.prior) for r in ranges.scan(df, ["k"], ["t"], made).collect()}
    want, by = {}, defaultdict(list)
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        before = [x for x in by[k] if x is not None]
        by[k].append(v)
        upto = [x for x in by[k] if x is not None]
        want[k, t] = (sum(upto), min(before, default=None), upto[-1] if upto else None, before[-1] if before else None)
    assert got == want


def test_scan_deals_one_key_to_many_tasks(spark):
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    # at this size adaptive execution would put all ranges together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = df.repartitionByRange("k", "t").withColumn("at", F.spark_partition_id())
    assert rows.groupBy("at").count().count() == 4
    out = ranges.scan(df, ["k"], ["t"], {"s": ranges.Over("total", F.col("v"))})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.s for r in out.where("t % 9999 = 0").collect()) == [sum(i % 7 for i in range(n + 1)) for n in range(0, 40_000, 9_999)]
    assert ranges.scan(df, ["k"], ["t"], {"s": ranges.Over("total", F.col("v"))}).agg(F.max("s")).first()[0] == sum(i % 7 for i in range(40_000))


def test_scan_over_given_ranges(spark):
    rows = [("f", b, i, "tag" if i == 3 else None) for b in range(5) for i in range(b * 4, b * 4 + 4)]
    got = ranges.scan(frame(spark, rows, "f string, block int, i int, tag string"), ["f"], ["block", "i"], {"seen": ranges.Over("latest", F.col("tag"))}, "block").collect()
    assert all(r.seen == ("tag" if r.i >= 3 else None) for r in got)


def test_boxes_equal_brute_force(spark):
    draw = random.Random(2)
    big = 2**63 - 1
    spans = [(0, 1), (-5, 5), (3, 3), (7, 2), (-(2**62), 2**62), (0, None), (2**40, 2**41)]
    span = lambda: draw.choice(spans) if draw.random() < 0.2 else (a := draw.randint(-200, 200), a + draw.choice([1, 3, 60, 1000]))
    inner = [(i, i % 2, *span(), *span()) for i in range(150)]
    probes = [(i, i % 2, draw.choice([None, 2**40, *range(-250, 250)]), draw.choice([2**41, *range(-250, 250)])) for i in range(200)]
    left, right = frame(spark, probes, "p int, k int, x long, t long"), frame(spark, inner, "b int, k int, x0 long, x1 long, t0 long, t1 long")
    holds = lambda at, low, high: at is not None and low <= at < (big if high is None else high)
    want = sorted((p, b) for p, k, x, t in probes for b, j, x0, x1, t0, t1 in inner if k == j and holds(x, x0, x1) and holds(t, t0, t1))
    got = boxes.box_join(left, right, [("x", "x0", "x1"), ("t", "t0", "t1")], ["k"]).select("p", "b").collect()
    assert sorted(map(tuple, got)) == want
    one = boxes.box_join(left, right, [("x", "x0", "x1")]).select("p", "b").collect()
    assert sorted(map(tuple, one)) == sorted((p, b) for p, _, x, _ in probes for b, _, x0, x1, *_ in inner if holds(x, x0, x1))
    # a point of one side in one dimension, of the other in the other
    a = frame(spark, [(i, x, *s) for i, (x, s) in enumerate((draw.randint(-99, 99), span()) for _ in range(120))], "a int, x long, t0 long, t1 long")
    c = frame(spark, [(i, *s, t) for i, (s, t) in enumerate((span(), draw.randint(-99, 99)) for _ in range(120))], "c int, x0 long, x1 long, t long")
    crossed = boxes.box_join(a, c, [("x", "x0", "x1"), ("t", "t0", "t1")]).select("a", "c").collect()
    assert sorted(map(tuple, crossed)) == sorted((r.a, s.c) for r in a.collect() for s in c.collect() if holds(r.x, s.x0, s.x1) and holds(s.t, r.t0, r.t1))
    assert boxes.box_join(left.limit(0), right, [("x", "x0", "x1")]).count() == boxes.box_join(left, right.limit(0), [("x", "x0", "x1")]).count() == 0


def test_boxes_are_never_broadcast(spark):
    """pc_resolve, overlapping_segments: Spark's figure for a side is that of its table without the entries."""
    segments = spark.range(500).selectExpr("id * 1000 AS base", "id * 1000 + 900 AS top", "id AS load_ns", "id + 7000 AS unload_ns")
    probes = spark.range(500).selectExpr("id AS probe", "id * 997 AS pc", "id * 3 AS at")
    plan = boxes.box_join(probes, segments, [("pc", "base", "top"), ("at", "load_ns", "unload_ns")])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_levels_are_the_first_that_fit(spark):
    draw = random.Random(4)
    ends = [0, 1, 7, 8, 9, 63, 64, 65, 2**62, 2**63 - 2, -(2**62), -(2**63) + 2**62, *[draw.randint(-(2 ** draw.randint(1, 62)), 2 ** draw.randint(1, 62)) for _ in range(300)]]
    rows = [(a, b) for a, b in zip(ends, draw.sample(ends, len(ends))) if a <= b] + [(a, a + d) for a in ends[:4] for d in range(70)] + [(-5, 2**63 - 2), (-(2**62), 2**63 - 2)]
    got = frame(spark, rows, "low long, last long").withColumn("level", boxes._level(F.col("low"), F.col("last"))).collect()
    assert all(r.level == next(i for i, w in enumerate(boxes._WIDTHS) if r["last"] // w - r.low // w < boxes.FANOUT) for r in got)


def test_an_address_loaded_ten_thousand_times(spark):
    n = 10_000
    segments = spark.range(n).selectExpr("4096L AS base", "4096L AS size", "id * 1000 AS load_ns", "IF(id = 9999, NULL, (id + 1) * 1000) AS unload_ns", "id AS function_id", "id AS ord", "1 AS exp_id")
    probes = spark.range(n).selectExpr("id", "4096L + id % 4096 AS pc", "id * 997 AS at")
    got = intervals.resolve_addresses(probes, segments, ["id"], "pc", "at")
    assert {r.id: r.function_id for r in got.collect()} == {i: i * 997 // 1000 for i in range(n)}
    # each probe meets one life
    joined = intervals.box_join(probes, segments.selectExpr("base", "base + size AS top", "load_ns", "unload_ns", "ord"), [("pc", "base", "top"), ("at", "load_ns", "unload_ns")])
    assert joined.count() == n
    assert intervals.overlapping_segments(segments).count() == 0


def test_overlaps_equal_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for i in range(250):
        base, load = draw.randint(0, 60), draw.randint(0, 60)
        rows.append((draw.randint(1, 2), i, base, draw.choice([0, 1, 5, 40]), load, draw.choice([None, load, load + 1, load + 7, load + 50, load - 3])))
    got = intervals.overlapping_segments(frame(spark, rows, "exp_id int, ord int, base long, size long, load_ns long, unload_ns long"))
    want = set()
    for e, i, b, s, lo, un in rows:
        for f, j, c, t, mo, vn in rows:
            un_, vn_ = (2**63 - 1 if u is None else u for u in (un, vn))
            shares = (c <= b < c + t) or (b <= c < b + s)
            if e == f and i != j and shares and lo < vn_ and mo < un_ and lo < un_ and mo < vn_:
                want.add((e, i, j) if (lo, i) < (mo, j) else (e, j, i))
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    # a segment that is unloaded no later than it is loaded lives for no time
    dead = {(e, i) for e, i, _, _, lo, un in rows if un is not None and un <= lo}
    assert {p for p in pairs if (p[0], p[1]) not in dead and (p[0], p[2]) not in dead} == want


def test_as_of_a_hot_key(spark):
    draw = random.Random(4)
    versions = [(draw.choice([1, 1, 1, 2, None]), draw.randint(0, 500), draw.randint(0, 99)) for _ in range(400)]
    probes = [(i, draw.choice([1, 1, 1, 2, 3, None]), draw.choice([None, 250, *range(-5, 520)])) for i in range(2_000)]
    got = intervals.as_of(frame(spark, probes, "p int, id int, at long"), frame(spark, versions, "id int, since long, f int"), "id", "at", "since", "f")

    def want(k, t):
        before = [(s, f) for j, s, f in versions if j == k and t is not None and s <= t]
        return max(before)[1] if before else None

    assert {r.p: r.f for r in got.collect()} == {p: want(k, t) for p, k, t in probes}


@pytest.mark.parametrize("order", ["unique", "tied"])
def test_trie_of_stacks(spark, order):
    draw = random.Random(5)
    rows = [(i if order == "unique" else i // 5, [draw.choice("abc") if draw.random() < 0.95 else None for _ in range(draw.randint(0, 5))], draw.randint(1, 9)) for i in range(300)]
    df = frame(spark, rows, "row_id long, stack array<string>, w long")
    tree = defaultdict(lambda: [0, 0, 10**9])
    for i, stack, w in rows:
        for k in range(len(stack) + 1):
            node = tree[tuple(stack[:k])]
            node[0] += w
            node[1] += w if k == len(stack) else 0
            node[2] = min(node[2], i)
    assert {tuple(r.path): (r.level, r.incl, r.excl, r.first) for r in stacks.path_tree(df, "w", "row_id").collect()} == {p: (len(p), *v) for p, v in tree.items()}
    trie = stacks.path_trie(df, "w").collect()
    by = {(r.a, r.b): r for r in trie}
    assert len(by) == len(tree)

    def path(r):
        return () if r.level == 0 else (*path(by[r.pa, r.pb]), r.function)

    assert {path(r): (r.incl, r.excl) for r in trie} == {p: tuple(v[:2]) for p, v in tree.items()}
    # breadth-first: by level, then when the prefixes were first seen, then the path, null first
    key = lambda p: (len(p), [tree[p[:k]][2] for k in range(len(p) + 1)], [(f is not None, f or "") for f in p])
    idx = {p: i + 1 for i, p in enumerate(sorted(tree, key=key))}
    want = sorted((idx[p], idx[p[:-1]] if p else 0, len(p), p[-1] if p else "<Total>", v[0]) for p, v in tree.items())
    assert sorted(map(tuple, stacks.flame_levels(df, "w", "row_id").collect())) == want


def test_deep_stacks(spark):
    deep = ["f%d" % (i % 50) for i in range(1_000)]
    df = frame(spark, [(1, deep, 2), (2, deep[:600] + ["g"] + deep[601:], 3)], "row_id long, stack array<string>, w long")
    levels = stacks.flame_levels(df, "w", "row_id").collect()
    assert len(levels) == 1_401 and max(r.level for r in levels) == 1_000
    assert {r.value for r in levels if r.level <= 600} == {5} and sum(r.value for r in levels if r.level == 1_000) == 5


def test_a_long_event_is_four_edges(spark):
    bins = 200_000
    df = frame(spark, [(1, bins * 10 - 5, bins * 10 - 10, 2, i) for i in range(50)], "exp_id int, tstamp long, evt_time long, mstate int, row_id long")
    out = timeline.state_spread(df, 0, 10, bins)
    assert out.agg(F.count("*"), F.min("bin"), F.max("bin"), F.countDistinct("bin")).first()[:] == (bins, 0, bins - 1, bins)


def events(draw):
    return [(draw.randint(1, 3), i, draw.randint(0, 300), draw.choice([None, 0, 5, 50])) for i in range(500)]


@pytest.mark.parametrize("relation", ["<", "<=", "=", ">=", ">"])
def test_lookups_of_a_probe_table(spark, relation):
    rows = events(random.Random(6))
    df = frame(spark, rows, "exp_id int, row_id long, tstamp long, evt_time long")
    times = [-5, 0, 17, 150, 150, 299, 300, 400]
    probes = frame(spark, [(i, e, t) for i, (e, t) in enumerate((e, t) for e in (1, 2, 3, 9) for t in times)], "p int, exp_id int, at long")
    got = {r.p: (r.row_id, r.tstamp) for r in timeline.lookup_all(probes, df, relation).collect()}
    want = {}
    for t in set(times):
        one = {r.exp_id: (r.row_id, r.tstamp) for r in timeline.lookup(df, t, relation).collect()}
        want |= {r.p: one.get(r.exp_id, (None, None)) for r in probes.where(F.col("at") == t).collect()}
    assert got == want


@pytest.mark.parametrize("direction", [-1, 0, 1])
def test_nearest_of_a_probe_table(spark, direction):
    rows = events(random.Random(7))
    df = frame(spark, rows, "exp_id int, row_id long, tstamp long, evt_time long")
    times = [-5, 0, 17, 100, 150, 299, 300, 400]
    probes = frame(spark, [(i, e, t) for i, (e, t) in enumerate((e, t) for e in (1, 2, 3, 9) for t in times)], "p int, exp_id int, at long")
    got = {r.p: (r.row_id, r.tstamp) for r in timeline.nearest_all(probes, df, direction=direction).collect()}
    want = {}
    for t in times:
        one = {r.exp_id: (r.row_id, r.tstamp) for r in timeline.nearest(df, t, direction=direction).collect()}
        want |= {r.p: one.get(r.exp_id, (None, None)) for r in probes.where(F.col("at") == t).collect()}
    assert got == want
