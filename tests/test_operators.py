"""Hand-made cases and small models of the profile-event operators."""

import random

from pyspark.sql import functions as F

from stackloom.functions import expressions as ex
from stackloom.functions import text
from stackloom.operators import filters, groups, heap, intervals, sorting, stacks, timeline

T = "<Total>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def samples(spark, *rows):
    return frame(spark, [(list(s), w) for s, w in rows], "stack array<string>, weight long")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_recursion(spark):
    df = samples(spark, ("abab", 3))
    rows = {r.function: (r.excl, r.incl) for r in stacks.function_totals(df, "weight").collect()}
    assert rows == {"a": (0, 3), "b": (3, 3)}
    assert as_dict(stacks.callees(df, ["a"], "weight")) == {"b": 3}
    assert as_dict(stacks.callers(df, ["a"], "weight")) == {T: 0, "b": 3}


def test_target_at_leaf(spark):
    df = samples(spark, ("xa", 2))
    assert stacks.callees(df, ["a"], "weight").collect() == []
    assert as_dict(stacks.callers(df, ["a"], "weight")) == {"x": 2}


def test_self_recursion(spark):
    df = samples(spark, ("aa", 1))
    assert as_dict(stacks.callees(df, ["a"], "weight")) == {"a": 0}
    assert as_dict(stacks.callers(df, ["a"], "weight")) == {T: 0, "a": 1}


def test_chain(spark):
    row = stacks.self_values(samples(spark, ("abcab", 5)), ["a", "b"], "weight").first()
    assert (row.attributed, row.excl, row.incl) == (5, 5, 5)
    root = stacks.self_values(samples(spark, ("ab", 5), ("", 2)), [T], "weight").first()
    assert (root.attributed, root.excl, root.incl) == (7, 2, 7)


def test_empty_and_null_stacks(spark):
    df = samples(spark, ("", 4), ("a", 1))
    assert {r.function: r.incl for r in stacks.function_table(df, "weight").collect()} == {T: 5, "a": 1}
    assert samples_empty(spark).count() == 0


def samples_empty(spark):
    return stacks.function_totals(samples(spark, ("a", 1)).limit(0), "weight")


def model_attribution(forest, chain):
    """Depth-first walk over all samples, one by one."""
    callers, callees = {}, {}
    k = len(chain)
    for stack, w in forest:
        p = [T, *stack]
        ms = [d for d in range(k - 1, len(p)) if p[d - k + 1 : d + 1] == list(chain)]
        for d in ms:
            inner = w if d == ms[-1] else 0
            if d >= k:
                callers[p[d - k]] = callers.get(p[d - k], 0) + inner
            if d + 1 < len(p):
                callees[p[d + 1]] = callees.get(p[d + 1], 0) + inner
    return callers, callees


def test_random_attribution(spark):
    rng = random.Random(1)
    forest = [("".join(rng.choice("abc") for _ in range(rng.randrange(7))), rng.randrange(1, 9)) for _ in range(200)]
    df = samples(spark, *forest)
    for chain in (["a"], ["b", "a"], ["a", "b", "c"], [T], [T, "a"]):
        callers, callees = model_attribution(forest, chain)
        assert as_dict(stacks.callers(df, chain, "weight")) == callers
        assert as_dict(stacks.callees(df, chain, "weight")) == callees


def test_null_passes(spark):
    df = frame(spark, [(1, None), (2, 0), (3, 5)], "id int, x long")
    assert [r.id for r in filters.view_filter(df, F.col("x")).orderBy("id").collect()] == [1, 3]


def test_unsigned(spark):
    df = frame(spark, [(-1, 1, 0)], "a long, b long, z long")
    row = df.select(ex.above("a", "b"), ex.quotient("a", "z"), ex.remainder("a", "z"), ex.quotient("a", "b"), ex.quotient("a", F.lit(10)), ex.remainder("a", F.lit(10)), ex.quotient("b", "a"), ex.remainder("b", "a")).first()
    assert tuple(row) == (1, 0, 0, -1, 1844674407370955161, 5, 0, 1)


def test_wrapping(spark):
    rng = random.Random(2)
    wrap = lambda v: (v + 2**63) % 2**64 - 2**63
    rows = [(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**63), 2**63)) for _ in range(200)]
    got = frame(spark, rows, "a long, b long").select("a", "b", ex.plus("a", "b"), ex.minus("a", "b"), ex.times("a", "b"), ex.negative("a"), ex.quotient("a", "b"), ex.remainder("a", "b")).collect()
    for a, b, *r in got:
        ua, ub = a % 2**64, b % 2**64
        assert r == [wrap(a + b), wrap(a - b), wrap(a * b), wrap(-a), wrap(ua // ub), wrap(ua % ub)]


def test_numbers(spark):
    texts = ["0x10", "010", "10", "0xffffffffffffffff", "TRUE", "0"]
    assert list(spark.range(1).select(*[ex.number(t).alias(f"c{i}") for i, t in enumerate(texts)]).first()) == [16, 8, 10, -1, 1, 0]


def test_ordered_in(spark):
    df = frame(spark, [(["a", "b", "c"],), (["a"],), ([],)], "s array<string>")
    want = F.array(F.lit("b"), F.lit("c"))
    assert [r[0] for r in df.select(ex.ordered_in(want, F.col("s"))).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(ex.ordered_in(F.array().cast("array<string>"), F.col("s"))).collect()] == [1, 1, 1]


HEAP = "exp_id int, row_id long, tstamp long, htype int, hsize long, hvaddr long, hovaddr long"


def leaks(spark, *rows):
    df = frame(spark, [(1, i, i, t, s, a, o) for i, (t, s, a, o) in enumerate(rows)], HEAP)
    return {r.row_id: (r.hleaked, r.link_row) for r in heap.leak_match(df).collect()}


def test_in_place_realloc(spark):
    assert leaks(spark, (0, 10, 8, 0), (2, 20, 8, 8)) == {0: (10, 0), 1: (0, 2)}


def test_free_before_malloc_and_address_zero(spark):
    assert leaks(spark, (1, 0, 8, 0), (0, 10, 8, 0), (0, 7, 0, 0)) == {0: (0, 0), 1: (10, 0), 2: (7, 0)}


def model_leaks(rows):
    """A map from address to the live allocation, row by row."""
    live, out = {}, {}
    for i, (t, s, a, o) in enumerate(rows):
        out[i] = [s if t in (0, 2, 3) else 0, 0]

        def release(addr, row=i):
            if addr and addr in live:
                j = live.pop(addr)
                out[j] = [0, row + 1]

        if t in (0, 2, 3) and a:
            live[a] = i
        if t in (1, 4):
            release(a)
        if t == 2:
            release(o)
    return {i: tuple(v) for i, v in out.items()}


def test_random_leaks(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(1, 50), rng.randrange(6), rng.randrange(6)) for _ in range(400)]
    assert leaks(spark, *rows) == model_leaks(rows)


def test_heap_size_counts_releases_that_are_filtered_out(spark):
    df = heap.leak_match(frame(spark, [(1, 0, 0, 0, 10, 8, 0), (1, 1, 1, 1, 0, 8, 0)], HEAP))
    rows = heap.heap_size(df, df.where("htype = 0")).orderBy("row_id").collect()
    assert [(r.row_id, r.net_alloc, r.cur_allocs) for r in rows] == [(0, 10, 10), (1, -10, 0)]


GC = "exp_id int, row_id long, kind string, tstamp long"


def test_gc_pairs(spark):
    nested = frame(spark, [(1, 1, "start", 1), (1, 2, "start", 2), (1, 3, "end", 5), (1, 4, "end", 6)], GC)
    assert [(r.start_ns, r.end_ns) for r in intervals.gc_pairs(nested).collect()] == [(1, 6)]
    early = intervals.gc_pairs(frame(spark, [(1, 1, "end", 4)], GC))
    assert [(r.start_ns, r.end_ns) for r in early.collect()] == [(0, 4)]
    runs = frame(spark, [(1, 2, 100)], "exp_id int, start_ns long, last_event_ns long")
    assert [(r.start_ns, r.end_ns) for r in intervals.gc_clip(early, runs).collect()] == [(2, 4)]


def test_interval_edges(spark):
    probes = frame(spark, [(1, i, t) for i, t in enumerate((9, 10, 20, 21))], "exp_id int, row_id long, tstamp long")
    table = frame(spark, [(1, 1, 10, 20, "x")], "exp_id int, id long, lo long, hi long, v string")
    got = intervals.first_interval(probes, table, ["row_id"], "tstamp", "lo", "hi", "id", "v", 4).orderBy("row_id")
    assert [r.v for r in got.collect()] == [None, "x", "x", None]
    open_ = intervals.first_interval(probes, table, ["row_id"], "tstamp", "lo", "hi", "id", "v", 4, closed=False).orderBy("row_id")
    assert [r.v for r in open_.collect()] == [None, "x", None, None]


def test_random_range_join(spark):
    rng = random.Random(4)
    table = [(1, i, lo := rng.randrange(-50, 500), lo + rng.choice([1, 5, 40, 3000])) for i in range(60)]
    probes = [(1, i, rng.randrange(-60, 600)) for i in range(200)]
    got = intervals.range_join(frame(spark, probes, "k int, p int, t long"), frame(spark, table, "k int, i int, lo long, hi long"), "t", "lo", "hi", 3, ["k"], fanout=4)
    assert {(r.p, r.i) for r in got.collect()} == {(p, i) for _, p, t in probes for _, i, lo, hi in table if lo <= t < hi}
    assert got.count() == got.distinct().count()


def test_thread_end_is_exclusive_and_open_intervals(spark):
    log = frame(spark, [(1, 1, 7, "start", 10, "t", "main"), (1, 2, 7, "end", 20, "t", "main"), (1, 3, 7, "start", 30, "t", "main")], "exp_id int, row_id long, tid long, kind string, tstamp long, name string, group_name string")
    threads = intervals.thread_intervals(log)
    assert [(r.start_ns, r.end_ns) for r in threads.orderBy("jthr_id").collect()] == [(10, 20), (30, None)]
    probes = frame(spark, [(1, i, 7, t) for i, t in enumerate((10, 20, 99))], "exp_id int, row_id long, thrid long, tstamp long")
    assert [r.jthr_id for r in intervals.thread_at(probes, threads, ["row_id"]).orderBy("row_id").collect()] == [1, 0, 2]


def test_segments_nest(spark):
    rows = [(1, i, kind, i, 100, 10, "s") for i, kind in enumerate(["unmap", "map", "map", "unmap", "unmap", "map"])]
    log = frame(spark, rows, "exp_id int, ord long, kind string, tstamp long, base long, size long, name string")
    got = intervals.segment_lifetimes(log).orderBy("ord").collect()
    assert [(r.load_ns, r.unload_ns) for r in got] == [(1, 4), (2, 3), (5, None)]


def test_latest_load_wins_and_version_before_first(spark):
    segs = frame(spark, [(0, 100, 1, None, 11, 1), (50, 100, 5, None, 12, 2)], "base long, size long, load_ns long, unload_ns long, function_id long, ord long")
    probes = frame(spark, [(1, 60, 9), (2, 60, 3), (3, 999, 9)], "id long, pc long, at long")
    assert {r.id: r.function_id for r in intervals.resolve_addresses(probes, segs, ["id"], "pc", "at").collect()} == {1: 12, 2: 11, 3: None}
    versions = frame(spark, [(1, 10, 5), (1, 20, 6)], "k long, since long, v long")
    asked = frame(spark, [(1, 9), (1, 10), (1, 25)], "k long, t long")
    assert sorted((r.t, r.v) for r in intervals.as_of(asked, versions, "k", "t", "since", "v").collect() if r.v) == [(10, 5), (25, 6)]


def test_native_only_recording(spark):
    rows = frame(spark, [(["f"], [], 0, None)], "native array<string>, java array<string>, jthr_id long, group_name string")
    assert intervals.resolve_stacks(rows).first().stack == ["<JVM-System>"]
    assert intervals.resolve_stacks(rows, prefer_native=True).first().stack == ["f"]


def model_high_water(rows, start, delta, bins):
    prior = [v for t, v in rows if t < start]
    last, out = (prior[-1] if prior else None), []
    for b in range(bins):
        own = [v for t, v in rows if start + b * delta <= t < start + (b + 1) * delta]
        with_prior = ([last] if b == 0 and prior else []) + own
        if with_prior:
            out.append(max(with_prior) if b == 0 and prior else max(0, *with_prior))
            last = with_prior[-1]
        else:
            out.append(last or 0)
    return out


def test_high_water(spark):
    rng = random.Random(5)
    for _ in range(6):
        rows = sorted({rng.randrange(60): rng.randrange(-20, 40) for _ in range(rng.randrange(1, 15))}.items())
        df = frame(spark, [(1, i, t, v) for i, (t, v) in enumerate(rows)], "exp_id int, row_id long, tstamp long, v long")
        got = timeline.high_water(df, "v", 15, 5, 8).orderBy("bin").collect()
        assert [r.value for r in got] == model_high_water(rows, 15, 5, 8)


def test_state_spread_truncates_each_addition(spark):
    df = frame(spark, [(1, 25, 22, 3)], "row_id long, tstamp long, evt_time long, mstate int")
    got = {r.bin: r.value for r in timeline.state_spread(df, 0, 10, 5).collect()}
    share = 22 / 2.2
    assert got == {0: int(share * (9 - 3) / 10), 1: int(share), 2: int(share * 5 / 10)}
    clipped = {r.bin: r.value for r in timeline.state_spread(df, 10, 10, 5).collect()}
    assert clipped == {0: int(share), 1: int(share * 5 / 10)}


def test_sorting_pins_the_total(spark):
    table = frame(spark, [("b", 1), (T, 9), ("a", 1), ("c", 5)], "function string, v long")
    assert [r.function for r in sorting.sort_result(table, "v").collect()] == [T, "c", "a", "b"]
    assert sorting.sort_result(table, "v", reverse=True).collect()[-1].function == T


def test_group_names():
    import pytest

    g = groups.Groups()
    g.define("mine", F.lit(1))
    for bad in ("1x", "a-b", "Mine"):
        with pytest.raises(ValueError):
            g.define(bad, F.lit(1))


def test_text(spark):
    df = frame(spark, [("(ILjava/lang/String;[[D)V", "Ljava/util/Map;", "12.5")], "d string, n string, t string")
    row = df.select(text.parameter_list("d"), text.dotted_name("n"), text.time_ns("t")).first()
    assert tuple(row) == ("(int, java.lang.String, double[][])", "java.util.Map", 12_000_000_005)


def test_nearest(spark):
    df = frame(spark, [(1, 0, 10, 0), (1, 1, 30, 5), (1, 2, 30, 5)], "exp_id int, row_id long, tstamp long, evt_time long")
    at = lambda t, d=0: timeline.nearest(df, t, direction=d).first().row_id
    assert [at(5), at(12), at(17), at(18), at(30), at(99)] == [0, 0, 0, 1, 1, 2]
    assert [at(5, -1), at(30, -1), at(29, -1), at(12, 1), at(99, 1)] == [0, 2, 0, 1, 2]


def test_steps_and_lookups(spark):
    df = frame(spark, [(1, i, t, 4) for i, t in enumerate((10, 20, 30))], "exp_id int, row_id long, tstamp long, evt_time long")
    assert {r.row_id: (r.to_row, r.center) for r in timeline.step(df, 1).collect()} == {0: (1, 18), 1: (2, 28), 2: (None, None)}
    found = {rel: [r.row_id for r in timeline.lookup(df, 20, rel).collect()] for rel in ("<", "<=", "=", ">=", ">")}
    assert found == {"<": [0], "<=": [1], "=": [1], ">=": [1], ">": [2]}


def test_an_event_that_ends_after_the_range(spark):
    df = frame(spark, [(1, 0, 5, 1), (1, 1, 25, 8), (1, 2, 26, 9)], "exp_id int, row_id long, tstamp long, evt_time long")
    bins = lambda **how: {r.bin: r.value for r in timeline.binned(df, 0, 10, 2, durations=True, lane=["exp_id"], **how).collect()}
    assert bins() == {0: 1}
    assert bins(tail=True) == {0: 1, 1: 1}
    reps = timeline.representatives(df, 0, 10, 2, reverse=True, tail=True)
    assert {r.bin: r.row_id for r in reps.collect()} == {0: 0, 1: 1}
