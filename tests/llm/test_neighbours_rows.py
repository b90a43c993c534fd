"""Embedding links of odd rows, and of the query's table, against brute force."""

from collections import Counter, defaultdict

import numpy as np

from stackloom.llm import neighbours, queries


def brute(rows, threshold=0.93):
    """(n_links, component id) of each place in rows (id, vector, label)."""
    by = defaultdict(list)
    for place, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / max(map(abs, v))
            by[label, len(v)].append((place, v / np.linalg.norm(v)))
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for group in by.values():
        x = np.stack([v for _, v in group])
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            a, b = group[i][0], group[j][0]
            n[a] += 1
            n[b] += 1
            up[find(a)] = find(b)
    ids = defaultdict(list)
    for place, row in enumerate(rows):
        ids[find(place)].append(row[0])
    low = {root: min((i for i in group if i is not None), default=None) for root, group in ids.items()}
    return [(k, low[find(place)]) for place, k in enumerate(n)]


def test_repeated_and_null_ids_extreme_values_and_extra_columns(spark):
    near = [1.0, 2.0, 3.0]
    rows = [(1, near, 0), (1, near, 0), (1, [-3.0, 0.1, 0.0], 0), (None, near, 0), (None, None, 0), (None, [9.0, -1.0, 0.0], 0)]
    rows += [(7, [x * 1e200 for x in near], 0), (8, [x * 1e-300 for x in near], 0), (9, near, 1), (10, near, None), (11, [1.0, None, 2.0], 0), (12, [], 0), (13, [0.0] * 3, 0), (14, [float("nan"), 1.0, 1.0], 0), (15, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, component_id string, n_links int")
    got = neighbours.near_duplicates(df).collect()
    want = Counter((i, n, low, i == low) for (i, *_), (n, low) in zip(rows, brute(rows), strict=True))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_op9_against_brute_force(spark, sf_dir, tmp_path):
    """The table itself holds no link: copies of its vectors, moved a little, are added."""
    table = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rng = np.random.default_rng(8)
    for k, (_, v, label) in enumerate(table[:60]):
        size = np.linalg.norm(v) / np.sqrt(len(v))
        table += [(10_000 + 100 * k + i, (np.array(v) + s * size * rng.normal(size=len(v))).tolist(), label) for i, s in enumerate(rng.uniform(0.0, 0.4, size=k % 30))]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    table = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    want = {row[0]: w for row, w in zip(table, brute(table), strict=True)}
    got = {r.vec_id: r for r in queries.op9_neighbours(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    links = sum(n for n, _ in want.values())
    assert links > 1000 and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * links
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_audit_covers_every_label_against_brute_force(spark):
    """Each id divisible by 20, in more labels than were once audited, in blocks smaller than a label."""
    rng = np.random.default_rng(12)
    rows = []
    for label in range(30):
        center = rng.normal(size=(3, 16))
        rows += [(len(rows) + i, (center[i % 3] + 0.3 * rng.normal(size=16)).tolist(), label) for i in range(40 if label else 900)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    classes = df.selectExpr("id", "label", "size(vector) AS dim", "vector", "1L AS n", "id % 20 = 0 AS asked")
    want = {label: [0, 0] for label in range(30)}
    counts = []
    for (i, _, label), (n, _) in zip(rows, brute(rows), strict=True):
        if i % 3 and n:  # links of every third vector were missed
            counts.append((i, n))
        if i % 20 == 0:
            want[label][0] += n
            want[label][1] += n if i % 3 else 0
    found = spark.createDataFrame(counts, "a long, n long")
    got = {r.label: [r.links, r.found] for r in neighbours.audit(classes, found, 0.93, each=0, block=100).collect()}
    assert got == want and want[0][0] > want[0][1] > 0
    # with some of each label besides, no label goes unaudited
    few = classes.where("id % 20 != 0")
    assert neighbours.audit(few, found, 0.93, each=3).count() == 30


def test_parts_of_cells_give_both_ends_the_same_links(spark):
    rng = np.random.default_rng(3)
    center = rng.normal(size=24)
    x = [(center + 0.3 * rng.normal(size=24)).tolist() for _ in range(300)]
    rows = [(i, v, 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    got = {r.vec_id: r for r in neighbours.near_duplicates(df, cell=20).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want)
    assert sum(r.n_links for r in got.values()) % 2 == 0
