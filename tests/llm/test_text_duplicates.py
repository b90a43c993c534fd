"""Near-duplicates verified on their texts, and buckets of several shards, against brute force."""

import random

from pyspark.sql import functions as F

from stackloom.llm import components, simhash
from stackloom.llm.common import marked_as_near, materialize


def grams(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def brute_heads(rows, least=0.8):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [rows[i] for i in range(len(rows)) if up[i] == i]


def near_copies(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        base = [rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randrange(60)) for _ in range(rng.randrange(20, 300))]
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 30))):
                words[rng.randrange(len(words))] = f"changed{rng.random()}"
            texts.append(" ".join(words))
    shared = " ".join(f"boiler{k}" for k in range(40))
    return texts + [shared + " " + " ".join(f"own{i}x{k}" for k in range(45)) for i in range(30)]


def test_near_copies_equal_brute_force(spark):
    rows = list(enumerate(near_copies()))
    want = brute_heads(rows)
    assert 25 < len(want) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"shard": 3, "block": 2, "hot": 5}):
        got = simhash.drop_near_duplicates(df, **how).collect()
        assert sorted(tuple(r) for r in got) == want
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    base = [f"word{i}" for i in range(200)]
    copy = base[:100] + ["other"] + base[101:]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(f"else{i}" for i in range(200)))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in got} == {1, 3}


def test_null_and_repeated_ids_lose_no_text(spark):
    rows = [(None, "one text of five words"), (None, "quite another text of words"), (7, "a third text stands here"), (7, "and a fourth one here"), (7, "a third text stands here"), (8, None), (9, "")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text or "" for r in got) == sorted({t or "" for _, t in rows})


def test_equal_ids_and_extra_columns(spark):
    a, b = "one text of some words here", "another text of other words there"
    rows = [(3, a, "x", 1), (5, a, "y", 2), (5, b, "z", 3), (5, b, "z", 3)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, n_words int")).collect()
    assert sorted(tuple(r) for r in got) == [(3, a, "x", 1), (5, b, "z", 3)]


def test_large_buckets_are_split(spark):
    """One bucket of several shards, in several rounds, with repeated fingerprints."""
    rng = random.Random(6)
    center, rows = rng.getrandbits(64), []
    for node in range(400):
        v = center
        for _ in range(rng.randrange(12)):
            v ^= 1 << rng.randrange(64)
        rows.append((1 if node < 300 else 2, node, v - (v >> 63 << 64)))
    df = spark.createDataFrame(rows, "bucket long, node long, fp long")
    linked = [(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0] and ((a[2] ^ b[2]) % 2**64).bit_count() <= 3]
    want = {}
    for a, b in linked:
        want.setdefault(a, set()).add(b)
        want.setdefault(b, set()).add(a)
    for shard, trees in ((2000, 128), (20, 4), (150, 1)):
        found = components.connected_components(simhash.bucket_links(df, 3, shard, trees))
        got = {r.node: r.component for r in found.collect()}
        up = {}
        for start in sorted(want):
            if start in up:
                continue
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in up:
                    up[x] = start
                    todo += want[x]
        assert {n: got.get(n, n) for n in up} == up and got.keys() <= up.keys()


def test_texts_without_near_copies_are_not_shuffled(spark):
    """Their keys are; a wide join shuffled all texts twice where its other side was too large to broadcast."""
    rng = random.Random(7)
    texts = [" ".join(f"{rng.getrandbits(64):016x}" for _ in range(1500)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[0] + " end"), (None, texts[1]), (201, texts[2]), (3, texts[3]), (202, None), (203, "")]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "docs")

    def written():
        of = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(of.apply(i).totalShuffleWrite() for i in range(of.size()))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        start = written()
        got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()]
        shuffled = written() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == sorted([(i, t) for i, t in enumerate(texts)] + [(202, None)], key=lambda r: r[0])
    assert shuffled < 0.25 * sum(map(len, texts))


def test_keys_that_may_be_held(spark):
    keys = spark.range(500).select((F.col("id") * 7).cast("string").alias("key"))
    rows = spark.range(35_000).select(F.col("id").cast("string").alias("key")).union(spark.createDataFrame([(None,)], "key string"))
    got = marked_as_near(rows, keys, "key", "near").groupBy((F.coalesce(F.col("key").cast("long"), F.lit(1)) % 7 == 0).alias("k"), (F.coalesce(F.col("key").cast("long"), F.lit(1)) < 3500).alias("low"), "near").count().collect()
    counts = {(r.k and r.low, r.near): 0 for r in got}
    for r in got:
        counts[(r.k and r.low, r.near)] += r["count"]
    assert counts[(True, True)] == 500 and (True, False) not in counts
    assert counts[(False, True)] < 0.1 * counts[(False, False)]
    assert {r.near for r in marked_as_near(rows, keys.where("false"), "key", "near").collect()} == {False}
