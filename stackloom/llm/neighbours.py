"""Embedding near-duplicates, found in robust-pruned flat graphs.

Vectors are linked where their labels are equal and their cosine is at least a
threshold. Equal vectors are one class from the start. The classes of a label
are dealt to overlapping cells around pivots; a cell with too many is split by
hash in parts, and of each pair of parts one is searched by the other. A part is
cut into overlapping cluster shards; in each shard every vector keeps a robust-pruned
list of neighbours, and the lists of all shards are united to one flat graph.
Each vector is looked up by greedy search from the shards' medoids (and from
itself), which then expands over all neighbours in range. Every link is
verified in double precision, so none is false; how many are found is audited
against brute force, in blocks, for every label: with all vectors whose id is
divisible by AUDIT_STEP and some more of each label. If too few are found of a
label, all is done again with wider overlap and beams. Labels that still miss too
many are then compared whole, block by block. The recall is logged.

Vectors that are null, zero, empty, or hold null or non-finite components, and
those without a label, link with nothing. Vectors of different length don't
link either. Every row has a row of the result: rows with one id, or with a null
id, are vectors of their own, and a null id is never the smallest of a component
unless all are null. Other columns aren't looked at. Empty tables give empty
results.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_names, materialize
from .components import connected_components
from .simhash import Forest

_log = logging.getLogger(__name__)
#: Classes that a cell is to hold on average; a part of a cell holds at most about twice as many.
CELL = 2_000
#: Numbers in all pivots at most, about; with more vectors, cells are larger and have more parts.
MAX_PIVOT_NUMBERS = 1 << 22
#: Vectors of a shard, neighbours of a node, candidates for them, slack of pruning, width of the beam.
SHARD, DEGREE, CANDIDATES, ALPHA, BEAM = 256, 16, 128, 1.2, 16
#: The audit asks for each vector whose id is divisible by the first (for ids that aren't integers: the id's
#: crc32), and for this many of each label besides, and as many of those with a link found.
AUDIT_STEP, LABEL_QUERIES = 20, 50
#: Vectors of a block of the audit.
AUDIT_BLOCK = 4_096
TARGET_RECALL = 0.95


def _unit(column: pa.Array | pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shards(x: np.ndarray, size: int, overlap: int = 2) -> list[np.ndarray]:
    """Places of the members of overlapping clusters of about ``size``."""
    k = -(-len(x) // size)
    if k == 1:
        return [np.arange(len(x))]
    near = x @ x[np.linspace(0, len(x) - 1, k).astype(int)].T
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(overlap, k)]
    out = []
    for c in range(k):
        members = np.flatnonzero((best == c).any(1))
        # a dense cluster may be far larger than the others: its list is cut in runs that share a half
        step = max(size, 1)
        out += [members[i : i + 2 * step] for i in range(0, max(len(members) - step, 1), step)] if len(members) else []
    return out


def _prune(x: np.ndarray, members: np.ndarray, degree: int, candidates: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges of one shard: from its candidates each node keeps the
    nearest and drops those that it is alpha times nearer to than the node. A
    first round with alpha 1 takes at most half of the list and reaches out of
    dense groups; a second one fills the list with what is near."""
    v = x[members]
    m = len(v)
    sims = v @ v.T
    np.fill_diagonal(sims, -2)
    c = min(candidates, m - 1)
    if c < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cand = np.argpartition(-sims, c - 1, axis=1)[:, :c]
    rows = np.arange(m)[:, None]
    cand = np.take_along_axis(cand, np.argsort(-sims[rows, cand], axis=1, kind="stable"), 1)
    dist = np.sqrt(np.maximum(2 - 2 * sims[rows, cand], 0))
    taken = np.zeros((m, c), bool)
    for slack, size in ((1.0, degree // 2), (alpha, degree - degree // 2)):
        live = ~taken
        for _ in range(min(size, c)):
            some = np.flatnonzero(live.any(1))
            if not len(some):
                break
            pick = live[some].argmax(1)
            taken[some, pick] = True
            node = cand[some, pick]
            to_pick = np.sqrt(np.maximum(2 - 2 * sims[node[:, None], cand[some]], 0))
            live[some] &= slack * to_pick > dist[some]
            live[some, pick] = False
    src, at = np.nonzero(taken)
    return members[src], members[cand[src, at]]


class FlatGraph:
    """The united lists of all shards of the vectors x, with their medoids."""

    def __init__(self, x: np.ndarray, shard: int = SHARD, degree: int = DEGREE, overlap: int = 2):
        self.x = x
        src, dst, medoids = [], [], []
        for members in _shards(x, shard, overlap):
            a, b = _prune(x, members, degree, CANDIDATES, ALPHA)
            src += [a, b]  # each list holds the node's own picks and those that picked it
            dst += [b, a]
            mean = x[members].mean(0)
            medoids.append(int(members[(x[members] @ mean).argmax()]))
        self.medoids = np.unique(medoids)
        edges = np.unique(np.concatenate(src) * len(x) + np.concatenate(dst))
        src, self.to = edges // len(x), edges % len(x)
        self.count = np.bincount(src, minlength=len(x))
        self.start = np.cumsum(self.count) - self.count

    def _step(self, q: np.ndarray, node: np.ndarray, seen: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unseen neighbours of nodes, each once for each query, and their cosines."""
        n = self.count[node]
        to = self.to[np.arange(int(n.sum())) + np.repeat(self.start[node] - (np.cumsum(n) - n), n)]
        q = np.repeat(q, n)
        new = ~seen[q, to]
        pair = np.unique(q[new] * seen.shape[1] + to[new])
        q, to = pair // seen.shape[1], pair % seen.shape[1]
        seen[q, to] = True
        return q, to, np.einsum("ij,ij->i", queries[q], self.x[to])

    def search(self, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of queries, nodes) in range; own is a query's node, or -1."""
        for at in range(0, len(queries), 256):
            yield from self._search(queries[at : at + 256], own[at : at + 256], threshold, beam, at)

    def _search(self, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(queries)
        seen = np.zeros((n, len(self.x)), bool)
        start = queries @ self.x[self.medoids].T
        first = np.argsort(-start, axis=1, kind="stable")[:, :beam]
        ids = np.full((n, beam), -1)
        sims = np.full((n, beam), -3.0)
        w = first.shape[1]
        ids[:, :w] = self.medoids[first]
        sims[:, :w] = np.take_along_axis(start, first, 1)
        seen[np.arange(n)[:, None], ids[:, :w]] = True
        has = np.flatnonzero(own >= 0)
        fresh = has[~seen[has, own[has]]]
        ids[fresh, -1], sims[fresh, -1] = own[fresh], 1.0
        seen[fresh, own[fresh]] = True
        done = ids < 0
        found_q, found_n = [np.nonzero(sims >= threshold)[0]], [ids[sims >= threshold]]
        while True:
            open_ = np.where(done, -9.0, sims)
            pick = open_.argmax(1)
            q = np.flatnonzero(open_[np.arange(n), pick] > -3)
            if not len(q):
                break
            done[q, pick[q]] = True
            fq, fn, s = self._step(q, ids[q, pick[q]], seen, queries)
            hit = s >= threshold
            found_q.append(fq[hit])
            found_n.append(fn[hit])
            # the best of the beam and of what was met, query by query
            widest = int(np.bincount(fq, minlength=1).max()) if len(fq) else 0
            if not widest:
                continue
            place = np.arange(len(fq)) - np.searchsorted(fq, fq)
            more, more_s = np.full((n, widest), -1), np.full((n, widest), -3.0)
            more[fq, place], more_s[fq, place] = fn, s
            all_ids, all_s, all_d = np.hstack([ids, more]), np.hstack([sims, more_s]), np.hstack([done, more < 0])
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(v, top, 1) for v in (all_ids, all_s, all_d))
        # range expansion: on over all neighbours of what is in range
        q, node = np.concatenate(found_q), np.concatenate(found_n)
        while len(q):
            yield q + at, node
            q, node, s = self._step(q, node, seen, queries)
            q, node = q[s >= threshold], node[s >= threshold]


def valid_vector(vector_col: str, label_col: str) -> Column:
    """The vector as array<double>, null where it can't link."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(F.col(label_col).isNotNull() & finite & F.exists(vector, lambda x: x != 0), vector)


def _cells(classes: DataFrame, cell: int, overlap: int) -> DataFrame:
    """Adds cell int and cells array<int>, one row for each of a class's cells."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    total = sizes.agg(F.coalesce(F.sum(F.col("size") * F.col("dim")), F.lit(0))).first()[0]
    cell = max(cell, -(-total // MAX_PIVOT_NUMBERS))
    # labels of more than one cell: each has more than cell classes, so they have MAX_PIVOT_NUMBERS numbers at most
    wanted = sizes.withColumn("k", F.ceil(F.col("size") / cell)).where("k > 1")
    # about k pivots for each of them, by a hash of the id: 2 x MAX_PIVOT_NUMBERS numbers in all on average at most
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    pivots = classes.join(F.broadcast(wanted), ["label", "dim"]).where(draw < F.col("k") / F.col("size"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["label", "dim", "id"]].assign(unit=[_unit(batch["vector"].iloc[i : i + 1]).astype(np.float32).tobytes() for i in range(len(batch))])

    drawn = pivots.select("label", "dim", "id", "vector").mapInPandas(packed, T.StructType([*(classes.schema[c] for c in ("label", "dim", "id")), T.StructField("unit", T.BinaryType())])).toPandas().sort_values("id", kind="stable")
    shared = classes.sparkSession.sparkContext.broadcast({k: np.stack([np.frombuffer(x, np.float32) for x in g["unit"]]) for k, g in drawn.groupby(["label", "dim"])})
    schema = T.StructType([*classes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells: list[list[int]] = [[0]] * len(batch)
            for key, places in batch.groupby(["label", "dim"]).indices.items():
                p = shared.value.get(tuple(key))
                if p is not None and len(p) > 1:
                    near = _unit(batch["vector"].iloc[places]).astype(np.float32) @ p.T
                    best = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
                    for i, b in zip(places.tolist(), best.tolist(), strict=True):
                        cells[i] = sorted(b)
            out = batch.assign(cell=cells, cells=cells)
            yield out.explode("cell").astype({"cell": "int32"})

    return classes.mapInPandas(run, schema)


def _pairs_of_parts(rows: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """rows in parts of about 2 x cell by a hash, each row once for each pair of
    parts (low, high) that its own is in."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / (2 * cell)).cast("int").alias("parts"))
    rows = rows.join(parts, keys).withColumn("own", F.pmod(F.xxhash64("id", F.lit(23)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("parts", "other")


def _report(ids: np.ndarray, total: np.ndarray, tree: list[tuple[int, int]]) -> pd.DataFrame:
    """Counts (a, null, n) and links (a, b, 0)."""
    some = np.flatnonzero(total)
    i, j = (np.array([t[k] for t in tree], np.int64) for k in (0, 1))
    return pd.DataFrame({"a": np.concatenate([ids[some], ids[i]]), "b": pd.array([*[None] * len(some), *ids[j].tolist()], "Int64"), "n": np.concatenate([total[some], np.zeros(len(i), np.int64)])})


def _links(classes: DataFrame, threshold: float, cell: int, overlap: int, beam: int) -> DataFrame:
    """(a, b, n): for each class a, in rows without b, how many vectors of
    other classes it links with; in rows with b, links that join what all join."""
    keys = ["label", "dim", "cell"]
    rows = _pairs_of_parts(_cells(classes, cell, overlap), keys, cell)

    def find(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        ids, count, own = group["id"].to_numpy(), group["n"].to_numpy(), group["own"].to_numpy()
        cross = group["low"].iloc[0] != group["high"].iloc[0]
        if len(group) < 2:
            return _report(ids, np.zeros(len(ids), np.int64), [])
        x = _unit(group["vector"])
        cells = np.array([(c + c[-1:] * overlap)[:overlap] for c in map(list, group["cells"])])
        here = int(group["cell"].iloc[0])
        forest, total = Forest(len(x)), np.zeros(len(x), np.int64)
        known = [np.zeros(0, np.int64)]
        # of two parts, the lower asks the graph of the higher
        asks = np.flatnonzero(own == group["low"].iloc[0])
        nodes = np.flatnonzero(own == group["high"].iloc[0])
        if not len(asks) or not len(nodes):
            return _report(ids, total, [])
        for q, node in FlatGraph(x[nodes], overlap=overlap).search(x[asks], np.full(len(asks), -1) if cross else np.arange(len(x)), threshold, beam):
            q, node = asks[q], nodes[node]
            keep = q != node
            # what one of two finds, both have
            known += [q[keep] * len(x) + node[keep], node[keep] * len(x) + q[keep]]
            if sum(map(len, known)) > 4_000_000:
                known = [np.unique(np.concatenate(known))]
        pairs = np.unique(np.concatenate(known))
        a, b = pairs // len(x), pairs % len(x)
        # of the cells that both are in, the first counts the pair
        first = np.concatenate([np.zeros(0, bool), *(np.where((cells[a[i : i + 500_000]][:, :, None] == cells[b[i : i + 500_000]][:, None, :]).any(2), cells[a[i : i + 500_000]], np.iinfo(np.int32).max).min(1) == here for i in range(0, len(a), 500_000))])
        np.add.at(total, a[first], count[b[first]])
        up = a < b
        return _report(ids, total, [(i, j) for i, j in zip(a[up].tolist(), b[up].tolist(), strict=True) if forest.join(i, j)])

    keep = [*keys, "low", "high", "own", "id", "n", "vector", "cells"]
    return rows.select(keep).groupBy(*keys, "low", "high").applyInPandas(find, "a long, b long, n long")


def _exact_links(classes: DataFrame, threshold: float, cell: int) -> DataFrame:
    """As _links, with all links counted: each pair of parts of a label is compared."""
    keys = ["label", "dim"]
    rows = _pairs_of_parts(classes, keys, cell)

    def find(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        ids, count, own = group["id"].to_numpy(), group["n"].to_numpy(), group["own"].to_numpy()
        x, within = _unit(group["vector"]), group["low"].iloc[0] == group["high"].iloc[0]
        forest, tree, total = Forest(len(x)), [], np.zeros(len(x), np.int64)
        for at in range(0, len(x), 512):
            near = x[at : at + 512] @ x.T >= threshold
            near &= (np.arange(at, at + len(near))[:, None] != np.arange(len(x))) & (within | (own[at : at + 512, None] != own))
            total[at : at + 512] = near @ count
            a, b = np.nonzero(near)
            tree += [(i, j) for i, j in zip((a + at).tolist(), b.tolist(), strict=True) if i < j and forest.join(i, j)]
        return _report(ids, total, tree)

    return rows.select(*keys, "low", "high", "own", "id", "n", "vector").groupBy(*keys, "low", "high").applyInPandas(find, "a long, b long, n long")


def audit(classes: DataFrame, counts: DataFrame, threshold: float, each: int = LABEL_QUERIES, block: int = AUDIT_BLOCK) -> DataFrame:
    """(label, dim, links, found): the links of the classes that are asked about
    with all of their label, by brute force, and how many of these counts (a, n)
    has. Asked are those marked so, ``each`` of any in a label, and of those that
    have a link in counts as many, so that labels with few links are seen to have
    some. Blocks of them meet blocks of all."""
    keys, place = ["label", "dim"], ["label", "dim", "block", "part"]
    order = Window.partitionBy(*keys, "linked").orderBy(F.xxhash64("id", F.lit(11)), "id")
    linked = classes.join(counts.select(F.col("a").alias("id")), "id").select("id", *keys, F.lit(True).alias("linked"))
    # the window keeps the first of each group before the shuffle
    some = classes.select("id", *keys, F.lit(False).alias("linked")).unionByName(linked).withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)
    ids = classes.where("asked").select("id").unionByName(some.select("id")).distinct()
    asked = materialize(classes.join(ids, "id", "left_semi").select("id", *keys, "vector"), "asked")
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = materialize(count(asked, "blocks").join(count(classes, "parts"), keys), "sizes")
    own = lambda of: F.pmod(F.xxhash64("id", F.lit(29)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asked.join(sizes, keys).withColumn("block", own("blocks")).withColumn("part", every("parts")).select(*place, "id", "vector")
    right = classes.join(sizes, keys).withColumn("part", own("parts")).withColumn("block", every("blocks")).select(*place, "id", "vector", "n")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, n = a["id"].to_numpy(), np.zeros(len(a), np.int64)
        if len(a) and len(b):
            x, y, of, many = _unit(a["vector"]), _unit(b["vector"]), b["id"].to_numpy(), b["n"].to_numpy()
            for at in range(0, len(x), 512):
                near = (x[at : at + 512] @ y.T >= threshold) & (ids[at : at + 512, None] != of)
                n[at : at + 512] = near @ many
        return pd.DataFrame({"a": ids, "n": n})

    true = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(compare, "a long, n long").groupBy("a").agg(F.sum("n").alias("true"))
    both = asked.select(F.col("id").alias("a"), *keys).join(true, "a").join(counts, "a", "left")
    return both.groupBy(*keys).agg(F.sum("true").alias("links"), F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("found"))


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL, target_recall: float = TARGET_RECALL) -> DataFrame:
    """(id, n_links long, component_id, kept boolean) for each row. kept says
    that the id is the component's."""
    check_names(id_col, ("n_links", "component_id", "kept"))
    rows = df.select(F.col(id_col).alias("key"), F.col(label_col).alias("label"), valid_vector(vector_col, label_col).alias("vector"))
    # all that follows goes by a row's number, which is written with it
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "vectors")
    members = rows.where("vector IS NOT NULL").select("id", "key", "label", F.size("vector").alias("dim"), "vector")
    whole_number = isinstance(df.schema[id_col].dataType, T.IntegralType)
    drawn = F.pmod(F.col("key") if whole_number else F.crc32(F.col("key").cast("string")), F.lit(AUDIT_STEP)) == 0
    classes = materialize(members.groupBy("label", "dim", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.coalesce(F.bool_or(drawn), F.lit(False)).alias("asked")), "classes")
    for overlap, beam in ((2, BEAM), (4, 4 * BEAM), (8, 16 * BEAM)):
        found = materialize(_links(classes, threshold, cell, overlap, beam), "found")
        counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
        recall = materialize(audit(classes, counts, threshold), "recall")
        poor = recall.where(F.col("found") < target_recall * F.col("links"))
        told = recall.agg(F.count("*"), F.sum("links"), F.sum("found"), F.count_if(F.col("found") < target_recall * F.col("links"))).first()
        _log.info("overlap %d, beam %d: of %d labels' %s audited links %s were found; labels below %s: %d", overlap, beam, told[0], told[1], told[2], target_recall, told[3])
        if not told[3]:
            break
    else:
        whole = materialize(classes.join(poor.select("label", "dim"), ["label", "dim"], "left_semi"), "poor")
        rest = found.join(whole.select(F.col("id").alias("a")), "a", "left_anti")
        found = materialize(rest.unionByName(_exact_links(whole, threshold, cell)), "found")
        counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "a")
    of_class = classes.select(F.col("id").alias("a"), "label", "dim", "vector", F.col("n").alias("same")).join(counts, "a", "left").join(roots, "a", "left")
    of_class = of_class.select("label", "dim", "vector", (F.col("same") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "a").alias("root"))
    linked = materialize(members.join(of_class, ["label", "dim", "vector"]).select("id", "key", "n_links", "root"), "linked")
    heads = linked.groupBy("root").agg(F.min("key").alias("head"))
    linked = linked.join(heads, "root").select("id", "n_links", "head")
    out = rows.select("id", "key").join(linked, "id", "left")
    head = F.coalesce("head", "key")
    return out.select(F.col("key").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), head.alias("component_id"), head.eqNullSafe(F.col("key")).alias("kept"))
