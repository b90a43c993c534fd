"""Centroids of vectors, exact in integers, with nearest centroids found by
Orchard's search.

Each component becomes floor(scale x). The first centroids are the vectors with
the smallest hashes of their ids. A round assigns every vector to its nearest
centroid (of equally near ones to that with the smaller number) and replaces each
centroid that has vectors by their componentwise floor(sum / count).

Orchard's search keeps for each centroid the list of all others, nearest first. A
vector starts at some centroid and walks its list; where it meets a nearer
centroid it jumps to the beginning of that one's list, past those that it has
met. It stops where the next centroid of the list is strictly farther from the
current one than twice the vector is: nothing farther on can be nearer or as near.

The driver holds the centroids and their lists alone. A round is one pass over
the table: tasks sum their vectors by centroid, and the sums are added in a shuffle
of at most tasks x k x components numbers, however large a cluster is.

Vectors that are null, have another number of components, or hold null or
non-finite ones are left out, and so are components from 2^80 on, whose sums no decimal
holds. Distances are exact; those that a long can't hold, and sums of distances
that it can't, are null. Rows with equal ids are vectors of their own, ordered by their
components where they tie for a first centroid; a null id hashes as an empty one.
With fewer vectors than k there are as many centroids as vectors. An empty table gives
an empty result. Only the id and the vector are looked at; the id may not have a
result's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_names, materialize

#: Magnitudes of components of which 64 have four times a squared distance that int64 holds.
_SMALL = 2**26
_LARGE = 2.0**80
#: Vectors of a block: what a task holds besides one batch.
BLOCK = 4096
_RESULTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def valid(vector: Column, size: int, scale: int) -> Column:
    """True for vectors that are kept."""
    value = lambda x: x.cast("double") * scale
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(value(x)) < _LARGE), F.lit(False)))
    return F.coalesce((F.size(vector) == size) & good, F.lit(False))


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as int64, or as Python integers where they are too large."""
    x = np.floor(x.astype(np.float64) * scale)
    if x.size == 0 or np.abs(x).max() < _SMALL * (64 / max(x.shape[1], 64)) ** 0.5:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], object)


@dataclass
class Orchard:
    """Centroids (k x n integers) with the lists of their neighbours."""

    centroids: np.ndarray

    def __post_init__(self) -> None:
        c = self.centroids
        gaps = np.array([((c - row) ** 2).sum(1) for row in c])
        # of equally near ones the smaller number first; a centroid isn't in its own list
        order = [sorted((j for j in range(len(c)) if j != i), key=lambda j, i=i: (gaps[i][j], j)) for i in range(len(c))]
        self.lists = np.array(order, np.int64).reshape(len(c), len(c) - 1)
        self.gaps = np.array([[gaps[i][j] for j in row] for i, row in enumerate(order)], gaps.dtype).reshape(len(c), len(c) - 1)

    def nearest(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, and how many
        distances were worked out. start: centroids to begin at."""
        c, n = self.centroids, len(x)
        if x.dtype != c.dtype:
            x, c = x.astype(object), c.astype(object)
        current = np.zeros(n, np.int64) if start is None else start.copy()
        best = ((x - c[current]) ** 2).sum(1)
        met = np.zeros((n, len(c)), bool)
        met[np.arange(n), current] = True
        at = np.zeros(n, np.int64)
        live, asked = np.arange(n), n
        while len(live):
            live = live[at[live] < len(c) - 1]
            # strictly beyond twice the distance: squares beyond four times
            live = live[self.gaps[current[live], at[live]] <= 4 * best[live]]
            other = self.lists[current[live], at[live]]
            at[live] += 1
            new = ~met[live, other]
            rows, other = live[new], other[new]
            if not len(rows):
                continue
            met[rows, other] = True
            asked += len(rows)
            far = ((x[rows] - c[other]) ** 2).sum(1)
            nearer = (far < best[rows]) | ((far == best[rows]) & (other < current[rows]))
            rows, other, far = rows[nearer], other[nearer], far[nearer]
            best[rows], current[rows], at[rows] = far, other, 0
        return current, best, asked


def _blocks(column: pa.Array, size: int, scale: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        yield _integers(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), size), scale)


def _start(x: np.ndarray, orchard: Orchard) -> np.ndarray:
    """Where a block's vectors begin: the centroid nearest to the block's mean."""
    mean = x.mean(0) if x.dtype != object else np.array([sum(col) // len(x) for col in x.T], object)
    gaps = [float(((orchard.centroids - mean) ** 2).sum(1)[i]) for i in range(len(orchard.centroids))]
    return np.full(len(x), int(np.argmin(gaps)), np.int64)


def first_centroids(vectors: DataFrame, k: int, seed: int, size: int, scale: int) -> np.ndarray:
    """The k vectors (id, vector) with the smallest sha256 of ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    found = vectors.select(F.sha2(name, 256).alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()  # k rows
    return _integers(np.array([r.vector for r in found], np.float64).reshape(len(found), size), scale)


def _sums(vectors: DataFrame, centroids: np.ndarray, size: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """number: (count, sums of the components) of the vectors nearest to each centroid."""
    orchard = Orchard(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _blocks(batch.column(0), size, scale):
                number, *_ = orchard.nearest(x, _start(x, orchard))
                for c in np.unique(number).tolist():
                    mine = x[number == c]
                    counts[c] = counts.get(c, 0) + len(mine)
                    # a block's sums fit into int64, a task's needn't
                    sums[c] = sums.get(c, np.zeros(size, object)) + mine.sum(0).astype(object)
        rows = [(c, -1, Decimal(counts[c])) for c in sums] + [(c, i, Decimal(v)) for c, s in sums.items() for i, v in enumerate(s)]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], ["cluster", "i", "v"])

    parts = vectors.select("vector").mapInArrow(run, "cluster int, i int, v decimal(38,0)")
    found = parts.groupBy("cluster", "i").agg(F.sum("v").alias("v")).collect()  # k x (components + 1) rows
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found:
        out.setdefault(r.cluster, (0, [0] * size))
    for r in found:
        if r.i < 0:
            out[r.cluster] = (int(r.v), out[r.cluster][1])
        else:
            out[r.cluster][1][r.i] = int(r.v)
    return out


def _as_array(rows: list[list[int]]) -> np.ndarray:
    large = max((abs(v) for row in rows for v in row), default=0) >= _SMALL
    return np.array(rows, object if large else np.int64)


def fit(vectors: DataFrame, k: int, rounds: int, seed: int, size: int, scale: int) -> np.ndarray:
    """Centroids after the given rounds, for (id, vector) rows that are valid."""
    centroids = first_centroids(vectors, k, seed, size, scale)
    for _ in range(rounds if len(centroids) else 0):
        sums = _sums(vectors, centroids, size, scale)
        # Python's // is the floor
        rows = [[s // sums[c][0] for s in sums[c][1]] if c in sums else [int(v) for v in row] for c, row in enumerate(centroids)]
        centroids = _as_array(rows)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, size: int, scale: int) -> DataFrame:
    """(id, cluster int, distance decimal) for (id, vector) rows that are valid."""
    orchard = Orchard(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1), size, scale):
                number, far, _ = orchard.nearest(x, _start(x, orchard))
                # from 10^38 on no decimal holds a square
                far = pa.array([Decimal(int(d)) if d < 10**38 else None for d in far.tolist()], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(number, pa.int32()), far], ["id", "cluster", "distance"])
                at += len(x)

    schema = T.StructType([vectors.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DecimalType(38, 0))])
    return vectors.select("id", "vector").mapInArrow(run, schema)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster int, distance long, cluster_inertia long, inertia long,
    centroid_sha256 string) for each valid vector."""
    check_names(id_col, _RESULTS)
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where(valid(F.col("vector"), size, scale))
    centroids = fit(rows, k, rounds, seed, size, scale)
    long = lambda c: F.when(c <= 2**63 - 1, c).cast("long")
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    found = materialize(assign(rows, centroids, size, scale), "clusters")
    # a null distance makes the sums that it is part of null
    total = lambda: F.when(F.count("*") == F.count("distance"), F.sum("distance"))
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(total().alias("s")).collect()}  # k rows
    inertia = None if None in sums.values() else sum(int(s) for s in sums.values())
    fit_long = lambda v: None if v is None or v > 2**63 - 1 else int(v)
    told = spark.createDataFrame([(c, fit_long(s), fit_long(inertia), digest(centroids[c])) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(told), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", long(F.col("distance")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(table: str = "embeddings", k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256) -> str:
    """DuckDB SQL for ``cluster``: every distance of every round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM {table} WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v
  FROM (SELECT v, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept ORDER BY h, v LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT id, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
    SELECT k.id, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k, c{r} c
  ) GROUP BY id
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT a.c, i, CAST(sum(k.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN kept k USING (id), range(1, {size + 1}) t(i) GROUP BY a.c, i
    ) GROUP BY c
  ) n USING (c)
)""")
    last = f"a{rounds}"
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT k.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} a JOIN kept k USING (id) JOIN c{rounds} c ON c.c = a.c
"""
    )
