"""SimHash near-duplicates, found in BK-trees.

A text's fingerprint has a bit set where more than half of its shingles' hashes
have it. Fingerprints are looked up in BK-trees, whose children hang on the
integer Hamming distance to their parent, along the edges that the radius
allows. Only fingerprints of one bucket are compared, and a bucket's trees are
shards of bounded size: a bucket of one shard is a tree in its own task; those
of larger buckets are broadcast, some at a time, and all fingerprints of the
bucket stream past them. Of the links found, a task passes on a spanning
forest, which has the same components.

``near_duplicates`` links fingerprints that differ in at most ``radius`` bits:
they agree on at least ``blocks - radius`` of ``blocks`` blocks of bits, so each
is sent to one bucket for every choice of that many blocks, and no link is lost.

``drop_near_duplicates`` links texts whose sets of shingles have a Jaccard
similarity of at least a threshold. The fingerprints of the sets of two texts of
similarity 0.8 are 10 bits apart on average, and more than RADIUS_TEXTS in a few of
100,000 cases. Such a radius lets many pairs of similarity 0.4 pass, so two more
fingerprints are made, and of all three together at most RADIUS_ALL bits may
differ (29 on average at 0.8). It leaves nearly all edges of a tree open, so buckets have to do more here: they are made of shingles. Of a text's SKETCH smallest
hashes, the first KEYS that don't stand in very many texts are its buckets; two
texts of similarity 0.8 share one but for some pairs in 10,000 at worst (where
all that they share stands in very many texts too). What is found joins texts to
groups of candidates; in a group, all pairs in the radius are verified on whole
texts, in blocks, unless links that are verified join them already.

Null and empty texts have no word and the fingerprint zero, which links like
any other. Rows with the same id have a row of the result each; a null id is
never the smallest of a component, unless all are null. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_names, marked_as_near, materialize
from .components import connected_components

#: bits of a fingerprint that may differ
RADIUS = 2
#: blocks that the 64 bits are cut into
BLOCKS = 4
#: fingerprints in a shard's tree (about, where a bucket has several), and trees that are broadcast at a time (about)
SHARD, TREES = 2_000, 128
#: verified near-duplicates: words of a shingle, least similarity, bits that may differ
SHINGLE, SIMILARITY, RADIUS_TEXTS = 5, 0.8, 22
#: bits that may differ of the three fingerprints of a text's set of shingles together
RADIUS_ALL = 54
#: smallest hashes kept of a text, and how many of them it is looked up by
SKETCH, KEYS = 32, 12
#: sketches that a hash may stand in before other hashes go first, and hashes that may have to wait:
#: fewer than SKETCH x texts / limit hashes can stand in more than limit sketches, which bounds them
HOT, MAX_HOT = 1_000, 1_000_000
#: texts of a block to verify
BLOCK = 500
SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; a text of fewer words is
    one shingle, a text without a word none."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_UPPER))
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one whole text; signed, as Spark's long holds it."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set, as a signed integer; 0
    for no hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long)."""
    check_names(id_col, ("fp", "component_id"))
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                got = [text_fingerprint(t, shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.int64())], [id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


class BKTree:
    """A BK-tree over distinct unsigned 64-bit integers, built level by level
    and searched for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.edge = np.zeros(n, np.int64)  # distance to the parent
        parent = np.full(n, -1, np.int64)
        at = np.zeros(n, np.int64)  # the node that each value still to be placed has come to
        left = np.arange(1, n)
        while len(left):
            d = np.bitwise_count(values[left] ^ values[at[left]]).astype(np.int64)
            slot = at[left] * 65 + d
            _, first = np.unique(slot, return_index=True)
            new = left[first]  # the first to come becomes the child at its distance
            parent[new], self.edge[new] = at[new], d[first]
            child = dict(zip(slot[first].tolist(), new.tolist(), strict=True))
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, slot = left[stay], slot[stay]
            at[left] = [child[s] for s in slot.tolist()]
        order = np.argsort(parent, kind="stable")
        self.child_list = order[np.searchsorted(parent[order], 0) :] if n else order
        self.child_count = np.bincount(parent[parent >= 0], minlength=n)
        self.child_start = np.cumsum(self.child_count) - self.child_count

    def search(self, queries: np.ndarray, radius: int, block: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of the values within the radius of them."""
        for i in range(0, len(queries), 2048):
            q = np.arange(i, min(i + 2048, len(queries)))
            stack = [(q, np.zeros(len(q), np.int64))] if len(self.values) else []
            while stack:
                q, node = stack.pop()
                if len(q) > block:
                    stack += [(q[:block], node[:block]), (q[block:], node[block:])]
                    continue
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                n = self.child_count[node]
                total = int(n.sum())
                if not total:
                    continue
                child = self.child_list[np.arange(total) + np.repeat(self.child_start[node] - (np.cumsum(n) - n), n)]
                near = np.abs(self.edge[child] - np.repeat(d, n)) <= radius
                if near.any():
                    stack.append((np.repeat(q, n)[near], child[near]))


class Forest:
    """Union-find over 0..n-1 that says which links joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def near_pairs(tree: BKTree, known: np.ndarray, asked: np.ndarray, radius: int, radius_all: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of asked and of known, the tree's, that are near: in the
    first column, and in all columns together where radius_all is given."""
    for q, n in tree.search(asked[:, 0], radius):
        if radius_all is not None:
            ok = np.bitwise_count(asked[q] ^ known[n]).sum(1, dtype=np.int64) <= radius_all
            q, n = q[ok], n[ok]
        yield q, n


def spanning_links(fps: np.ndarray, radius: int, radius_all: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of links between rows of fingerprints, which may repeat: enough to
    join what all links join."""
    values, first, of = np.unique(fps, axis=0, return_index=True, return_inverse=True)
    of = of.reshape(-1)
    same = np.flatnonzero(first[of] != np.arange(len(fps)))
    a, b = first[of[same]].tolist(), same.tolist()
    forest = Forest(len(values))
    for q, node in near_pairs(BKTree(values[:, 0]), values, values, radius, radius_all):
        for x, y in zip(q[q < node].tolist(), node[q < node].tolist(), strict=True):
            if forest.join(x, y):
                a.append(first[x])
                b.append(first[y])
    return np.array(a, np.int64), np.array(b, np.int64)


def _fingerprints_of(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in names], axis=1)


def bucket_links(rows: DataFrame, radius: int, shard: int = SHARD, trees: int = TREES, radius_all: int | None = None) -> DataFrame:
    """Links (a, b) between nodes of one bucket whose fingerprints are at most
    radius bits apart, for rows (bucket, node, fp), all long: not all links, but
    enough to have the same components. Where radius_all is given, rows have
    more fingerprints, which count for it."""
    names = [c for c in rows.columns if c not in ("bucket", "node")]
    # buckets of one row hold no link
    size = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = rows.join(size.where(F.col("n") <= shard), "bucket").select("bucket", "node", *names)
    small = small.repartition(parts, "bucket").sortWithinPartitions("bucket", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last bucket so far, which may go on: a shard at most
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = table.column("bucket").to_numpy()
            change = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
            rest = table.slice(change[-1] if change else 0)
            if change:
                yield from buckets(table.slice(0, change[-1]), [0, *change])
        if rest is not None and rest.num_rows:
            yield from buckets(rest, [0, rest.num_rows])

    def buckets(table: pa.Table, at: list[int]) -> Iterator[pa.RecordBatch]:
        node, fps = table.column("node").to_numpy(), _fingerprints_of(table, names)
        a, b = [], []
        for i, j in zip(at, at[1:], strict=False):
            if j - i == 2:  # the usual bucket: a tree of one node and its child
                apart = np.bitwise_count(fps[i] ^ fps[i + 1])
                near = apart[0] <= radius and (radius_all is None or apart.sum(dtype=np.int64) <= radius_all)
                x = np.array([0] if near else [], np.int64)
                y = x + 1
            else:
                x, y = spanning_links(fps[i:j], radius, radius_all)
            a.append(node[i:j][x])
            b.append(node[i:j][y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    found = small.mapInArrow(run, "a long, b long")
    large = materialize(size.where(F.col("n") > shard), "large_buckets")
    return found if large.isEmpty() else found.unionByName(_large_bucket_links(rows.join(large, "bucket"), names, radius, shard, trees, radius_all))


def _large_bucket_links(rows: DataFrame, names: list[str], radius: int, shard: int, trees: int, radius_all: int | None) -> DataFrame:
    """As bucket_links, for buckets of several shards. Each round broadcasts
    the trees of about ``trees`` shards, and all rows of their buckets ask."""
    tree = F.pmod(F.xxhash64(*names, F.lit(5)), F.ceil(F.col("n") / shard))
    rows = materialize(rows.select("bucket", "node", *names, tree.alias("tree")), "large")
    # nodes with the same fingerprints hang on the smallest of them, which stands for all
    keys = ["bucket", "tree", *names]
    heads = rows.groupBy(*keys).agg(F.min("node").alias("node"))
    same = rows.join(heads.withColumnRenamed("node", "head"), keys).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    heads = materialize(heads, "heads")
    rounds = max(1, -(-heads.select("bucket", "tree").distinct().count() // trees))
    heads = heads.withColumn("round", F.pmod(F.xxhash64("bucket", "tree", F.lit(9)), F.lit(rounds)))
    found = [same]
    for k in range(rounds):
        some = heads.where(F.col("round") == k).select("bucket", "tree", "node", *names).toPandas()
        shards: dict[int, list] = {}
        for (bucket, _), g in some.groupby(["bucket", "tree"]):
            shards.setdefault(int(bucket), []).append((g["node"].to_numpy(), g[names].to_numpy().view(np.uint64)))
        shared = rows.sparkSession.sparkContext.broadcast(shards)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            grown = {bucket: [(node, fps, BKTree(fps[:, 0])) for node, fps in of] for bucket, of in shared.value.items()}
            for batch in batches:
                bucket, node, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _fingerprints_of(batch, names)
                for key in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == key)
                    ids, asked = node[at], fps[at]
                    for nodes, known, tree in grown.get(key, ()):
                        links, a, b = Forest(len(at) + len(nodes)), [], []
                        for q, n in near_pairs(tree, known, asked, radius, radius_all):
                            for x, y in zip(q.tolist(), n.tolist(), strict=True):
                                if links.join(x, len(at) + y):
                                    a.append(x)
                                    b.append(y)
                        a, b = ids[np.array(a, np.int64)], nodes[np.array(b, np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        found.append(materialize(heads.select("bucket", "node", *names).mapInArrow(run, "a long, b long"), "tree_links"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks - radius blocks."""
    if not 0 < radius < blocks <= 64:
        raise ValueError("need 0 < radius < blocks <= 64")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    masks = [sum(c) for c in combinations(one, blocks - radius)]
    return [m - (m >> 63 << 64) for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD, trees: int = TREES) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp that are at
    most radius bits apart: not all, but enough to have the same components."""
    # two buckets whose hashes are the same are one bucket, in which no more is linked
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(blocks, radius))])
    rows = fps.select(F.explode(F.array_distinct(keys)).alias("bucket"), F.col("fp").alias("node"), "fp")
    return bucket_links(rows, radius, shard, trees)


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(id, fp long, component_id): the smallest id that a document reaches
    over links between fingerprints, itself included."""
    docs = materialize(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    classes = docs.groupBy("fp").agg(F.min(id_col).alias("__low"))
    joined = connected_components(links(classes.select("fp"), radius, blocks, shard))
    linked = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "__low", F.coalesce("component", "fp").alias("root"))
    heads = linked.groupBy("root").agg(F.min("__low").alias("component_id"))
    ids = materialize(linked.join(heads, "root").select("fp", "component_id"), "components")
    return docs.join(ids, "fp").select(id_col, "fp", "component_id")


# ---- near-duplicates verified on their texts ----


def _key(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def sketches(texts: DataFrame, shingle: int = SHINGLE, size: int = SKETCH) -> DataFrame:
    """(key, fp, fp2, fp3 long, sketch array<long>) for texts (key, text): three
    fingerprints and the smallest hashes of the set of shingles, ascending as
    unsigned. Texts without a word have the hash 0 alone."""

    def one(text: str | None) -> tuple[int, int, int, list[int]]:
        hashes = np.unique(shingle_hashes(text, shingle))
        second = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        second ^= second >> np.uint64(32)
        third = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        third ^= third >> np.uint64(33)
        return majority(hashes), majority(second), majority(third), hashes[:size].view(np.int64).tolist() or [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = [one(t) for t in part.column(1).to_pylist()]
                fps = [pa.array([g[k] for g in got], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *fps, pa.array([g[3] for g in got], pa.list_(pa.int64()))], ["key", "fp", "fp2", "fp3", "sketch"])

    return texts.select("key", "text").mapInArrow(run, "key string, fp long, fp2 long, fp3 long, sketch array<long>")


def text_buckets(sets: DataFrame, keys: int = KEYS, hot: int = HOT, max_hot: int = MAX_HOT) -> DataFrame:
    """(bucket, node, fp, fp2, fp3) for sets (node, the same, sketch): the first
    keys of each sketch; hashes in very many sketches come last."""
    total = sets.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()[0]
    limit = max(hot, -(-total // max_hot))  # so that fewer than max_hot hashes exceed it
    often = sets.select(F.explode("sketch").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    shared = sets.sparkSession.sparkContext.broadcast(np.sort(often.select("h").toPandas()["h"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sketch = pa.concat_arrays([part.column(4)])
                h, ends = sketch.flatten().to_numpy(), sketch.offsets.to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(ends))
                is_hot = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h if len(late) else np.zeros(len(h), bool)
                order = np.lexsort((is_hot, row))  # stable: by hash within each half
                place = np.arange(len(h)) - (ends - ends[0])[row[order]]
                take = order[place < keys]
                of = pa.array(row[take])
                yield pa.RecordBatch.from_arrays([pa.array(h[take]), *(part.column(k).take(of) for k in range(4))], ["bucket", "node", "fp", "fp2", "fp3"])

    return sets.select("node", "fp", "fp2", "fp3", "sketch").mapInArrow(run, "bucket long, node long, fp long, fp2 long, fp3 long")


def _verify(group: pd.DataFrame, shingle: int, least: Fraction, radius: int) -> pd.DataFrame:
    """Links (a, b) that join what all pairs of the group join that are within
    the radius and reach the threshold. Of two blocks, pairs with one text in
    each are looked at."""
    group = group.sort_values("node", kind="stable")
    node, text, block = group["node"].tolist(), group["text"].tolist(), group["block"].to_numpy()
    cross = bool(group["low"].iloc[0] != group["high"].iloc[0])
    fps = group[["fp", "fp2", "fp3"]].to_numpy().view(np.uint64)
    sets: dict[int, np.ndarray] = {}
    forest, out = Forest(len(node)), []

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.unique(shingle_hashes(text[i], shingle))
        return sets[i]

    for q, n in near_pairs(BKTree(fps[:, 0]), fps, fps, radius, RADIUS_ALL):
        ok = (q < n) & ((not cross) | (block[q] != block[n]))
        for i, j in zip(q[ok].tolist(), n[ok].tolist(), strict=True):
            if forest.find(i) == forest.find(j):
                continue
            x, y = shingles(i), shingles(j)
            # the smaller set bounds what both can share
            if min(len(x), len(y)) * least.denominator < least.numerator * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * (least.numerator + least.denominator) >= least.numerator * (len(x) + len(y)):
                forest.join(i, j)
                out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def verified_links(groups: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, least: Fraction, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes of one group (node, component) whose texts
    reach the threshold, enough to join what all of them join."""
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    size = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    groups = groups.join(size, "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    wanted = materialize(sets.select("node", "key", "fp", "fp2", "fp3").join(groups, "node"), "groups")
    # most texts are in no group: they stay where they are, and copies of one text become one
    some = marked_as_near(texts, wanted, "key", "__near").where("__near").drop("__near").dropDuplicates(["key"]).join(wanted, "key")
    # a text goes to each pair of blocks that its own is in: just one where the group is small
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = some.withColumn("other", other).select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "fp", "fp2", "fp3", "text")
    return sent.groupBy("component", "low", "high").applyInPandas(lambda g: _verify(g, shingle, least, radius), "a long, b long")


def text_components(df: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS_TEXTS, text_col: str = "text", shard: int = SHARD, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(key, component), both md5 of a text in hex, for each text of df that is
    linked with a different one."""
    least = Fraction(str(similarity))
    if not 0 < least <= 1:
        raise ValueError("need 0 < similarity <= 1")
    texts = df.select(_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = sketches(texts, shingle).dropDuplicates(["key"]).withColumn("node", F.monotonically_increasing_id())
    sets = materialize(sets, "sketches")
    groups = connected_components(bucket_links(text_buckets(sets, hot=hot), radius, shard, radius_all=RADIUS_ALL))
    found = connected_components(verified_links(groups, sets, texts, shingle, least, radius, block))
    names = sets.select("node", "key")
    heads = names.select(F.col("node").alias("component"), F.col("key").alias("head"))
    of = found.join(names, "node").join(heads, "component").select("key", F.col("head").alias("component"))
    return of.union(of.select("component", "component").distinct())


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """df with one row for each component of its texts (text_components): that
    of its smallest id, null last, then of the smallest md5 of its text. Rows
    with a null id or the same id are told apart by their texts."""
    check_names(id_col, ("__key", "__n", "__near"))
    linked = text_components(df, text_col=text_col, **how).select(F.col("key").alias("__key"), "component")
    rows = df.select(F.col(id_col).alias("__id"), _key(text_col).alias("__key")).groupBy("__id", "__key").agg(F.count("*").alias("__n"))
    rows = rows.join(linked, "__key", "left").withColumn("component", F.coalesce("component", "__key"))
    # a component's head is found by a sum, so that none is gathered in one task
    place = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))
    rows = materialize(rows, "rows")
    heads = rows.groupBy("component").agg(F.min(place).alias("__head"))
    marked = rows.join(heads, "component").withColumn("__drop", ~F.col("__id").eqNullSafe(F.col("__head.id")) | (F.col("__key") != F.col("__head.key")))
    marked = materialize(marked.where("__drop OR __n > 1").select("__id", "__key", "__drop"), "marked")
    # only texts that may be marked are shuffled
    rest = marked_as_near(df.withColumn("__key", _key(text_col)), marked, "__key", "__near")
    keyed = rest.where("__near").drop("__near")
    same = lambda m: (keyed["__key"] == m["__key"]) & keyed[id_col].eqNullSafe(m["__id"])
    kept = rest.where("NOT __near").select(*df.columns).unionByName(keyed.join(marked, same(marked), "left_anti").select(*df.columns))
    again = marked.where("NOT __drop")
    if again.isEmpty():
        return kept
    # of rows with the same id and text one stays
    order = Window.partitionBy(id_col, "__key").orderBy(*[F.col(c).cast("string") for c in df.columns])
    once = keyed.join(again, same(again), "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return kept.unionByName(once.select(*df.columns))
