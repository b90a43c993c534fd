"""Centroids against brute force in Python integers and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from stackloom.llm import centroids, queries

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, k=40, rounds=5, seed=2, size=64, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(range(len(kept)), key=lambda n: (hashlib.sha256(f"{seed}:{'' if kept[n][0] is None else kept[n][0]}".encode()).hexdigest(), kept[n][1]))
    c = [kept[n][1] for n in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, row, strict=True)), n) for n, row in enumerate(c))
    for r in range(rounds + 1):
        near = [nearest(v) for _, v in kept]
        if r < rounds:
            mine = [[v for (_, v), (_, n) in zip(kept, near, strict=True) if n == m] for m in range(len(c))]
            c = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else row for m, row in zip(mine, c, strict=True)]
    sums = [sum(d for d, n in near if n == m) for m in range(len(c))]
    long = lambda v: v if v < 2**63 else None
    return sorted(((i, n, long(d), long(sums[n]), long(sum(sums)), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, near, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_orchard_finds_the_nearest_and_prunes():
    draw = np.random.default_rng(1)
    for spread in (2, 50, 3000):  # few values make ties
        c = draw.integers(-spread, spread, (30, 3))
        x = draw.integers(-spread, spread, (500, 3))
        gaps = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
        number, far, asked = centroids.Orchard(c).nearest(x)
        assert (number == gaps.argmin(1)).all() and (far == gaps.min(1)).all()
        assert asked < 0.8 * gaps.size
    one, far, _ = centroids.Orchard(c[:1]).nearest(x)
    assert (one == 0).all() and (far == gaps[:, 0]).all()


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    mine = got(queries.op13_centroids(spark, sf_dir))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert mine == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op13_centroids"]).fetchall(), key=repr) == mine


def test_odd_rows_repeated_ids_and_ties(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i) if i % 9 else None, [float(x) for x in draw.integers(-2, 3, 4) / 4]) for i in draw.integers(0, 60, 200)]
    rows += [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan"), 0.0, 0.0, 0.0]), (6, [0.0, float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, vector string, id int")
    for k in (1, 7, 300):
        want = brute(rows, k=k, rounds=3, size=4)
        assert got(centroids.cluster(df, k=k, rounds=3, size=4)) == want


def test_values_above_int64_are_exact(spark):
    rows = [(i, [float(i) * 2.0**e, 1.5, -(2.0**e)]) for i in range(12) for e in (20, 40, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(centroids.cluster(df, k=5, rounds=2, size=3)) == brute(rows, k=5, rounds=2, size=3)


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(ValueError):
        centroids.cluster(empty.withColumnRenamed("vec_id", "inertia"), id_col="inertia")
