"""Corpus operators against brute force, round trips and held-out accuracy."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stackloom.llm import bpe, components, language, licenses, neighbours, packing, quality, queries, secrets, signatures, simhash, surrogates, toxicity

PATH = public_tokenizers.path(queries.WORD_BPE)
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "a", "Σ ΑΣ. It's we'll 12345 _x_!!", "x\x1c!y \x85 z", "<|endoftext|> A<|ENDOFTEXT|>b", "é​ﬁ 😀😀", "aaaaaaaaab" * 40, "word " * 3000]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


# ---- tokens ----


def test_op1_equals_the_library(spark, sf_dir, corpus, library):
    import hashlib

    got = {r.doc_id: r for r in queries.op1_bpe(spark, sf_dir).collect()}
    assert got.keys() == corpus.keys()
    for i, text in corpus.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts_encode_as_the_library_does(spark, library):
    got = {r.doc_id: r for r in bpe.encode(docs(spark, ODD), PATH, decoded=True).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    again = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs(spark, ODD), PATH), PATH).collect()}
    assert again == {i: r.decoded for i, r in got.items()}


def test_random_words_encode_as_the_library_does(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaabbcdeé' .,!12ß") for _ in range(rng.randrange(200))) for _ in range(300)]
    encoder = bpe.Encoder(bpe.vocabulary(bpe.read_vocabulary(PATH)))
    for keys, flat, counts in encoder.blocks(enumerate(texts)):
        for k, ids in zip(keys, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
            assert ids.tolist() == library.encode(texts[k], add_special_tokens=False).ids


def test_memory_of_a_block_of_new_words(library):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(4, 12))) for _ in range(120_000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(1_200)]
    encoder = bpe.Encoder(bpe.vocabulary(bpe.read_vocabulary(PATH)))
    tracemalloc.start()
    most, seen = 0, []
    for keys, flat, counts in encoder.blocks(enumerate(texts)):
        most = max(most, len(flat))
        seen += keys
        if not keys[0] % 400:
            assert flat[: counts[0]].tolist() == library.encode(texts[keys[0]], add_special_tokens=False).ids
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == list(range(len(texts)))
    assert peak < 90e6 and most < 1_000_000  # the peak was 132 MB when all places were lists and a block was given out whole


def test_special_tokens_by_their_spelling_alone(library):
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", " ", "a", "B ", "<|", "|>", "<|endoftext", "é", "\n", "K"]
    texts = parts + ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(1000)]
    encoder = bpe.Encoder(bpe.vocabulary(bpe.read_vocabulary(PATH)))
    for keys, flat, counts in encoder.blocks(enumerate(texts)):
        for k, ids in zip(keys, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
            assert ids.tolist() == library.encode(texts[k], add_special_tokens=False).ids


def test_tokens_of_odd_rows(spark, library):
    rows = [(1, "a <|EndOfText|> b", [7]), (1, "a <|EndOfText|> b", [7]), (None, None, None), (2, "word <|endoftext|>" * 20_000, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.encode(df, PATH).collect()))
    assert got == sorted((i or 0, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert bpe.encode(df.limit(0), PATH).count() == 0
    packed = packing.pack_documents(df.withColumn("offset", F.lit("x")), PATH, max_tokens=512).collect()
    assert sum(r.length for r in packed) == sum(len(ids) + 1 for _, ids in got)


def test_repeated_and_null_ids_are_spread_over_shards(spark):
    pieces = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).cast("long").alias("length"), F.lit("y").alias("sequence_id"))
    rows = packing.pack(pieces, max_tokens=8, shard_pieces=100).collect()
    size = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 4000 and len(size) == 40 and max(size.values()) < 200
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r.offset)
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 8 for v in bins.values())


def test_name_clash_is_refused(spark):
    with pytest.raises(ValueError):
        bpe.encode(docs(spark, ["a"]).withColumnRenamed("doc_id", "ids"), PATH, id_col="ids")


def check_packing(rows, texts, library, size):
    at = {}
    for r in rows:
        at.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = sorted(at[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in pieces] == [(k, min(size, len(ids) - k)) for k in range(0, len(ids), size)]
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    assert len(bins) <= -(-total // size) * 1.01 + 1


def test_op5_packs_everything_tightly(spark, sf_dir, corpus, library):
    check_packing(queries.op5_packing(spark, sf_dir).collect(), corpus, library, 2048)


def test_packing_in_shards_of_odd_texts(spark, library):
    df = docs(spark, ODD * 4)
    rows = packing.pack_documents(df, PATH, max_tokens=64, shard_pieces=50).collect()
    check_packing(rows, dict(enumerate(ODD * 4)), library, 64) if len({r.sequence_id >> 32 for r in rows}) == 1 else None
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in ODD * 4)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark, library):
    texts = {i: t for i, t in enumerate(ODD)}
    df = docs(spark, ODD)
    packed = packing.pack_documents(df, PATH, max_tokens=128)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed, bpe.encode(df, PATH), 128).collect()}
    for r in packed.collect():
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]


def test_squares_choose_the_smallest_sum():
    packer = packing.SquaresPacker(10)
    counts, bins = Counter(), {}
    for length in [random.Random(2).randrange(1, 11) for _ in range(1)] + [random.Random(i).randrange(1, 11) for i in range(300)]:
        def cost(gap, n=length):
            c = Counter(counts)
            if gap < 10:
                c[gap] -= 1
            if gap > n:
                c[gap - n] += 1
            return sum(v * v for k, v in c.items() if k)

        options = [10] if length == 10 else [g for g in range(length, 10) if counts[g] > 0] + [10]
        at, offset = packer.place(length)
        gap = 10 - offset
        assert cost(gap) == min(map(cost, options))
        assert bins.get(at, 0) == offset
        bins[at] = offset + length
        if gap < 10:
            counts[gap] -= 1
        if gap > length:
            counts[gap - length] += 1


# ---- near-duplicates ----


def brute_fingerprint(text):
    words = text_words(text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def text_words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_simhash(rows, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    ids = sorted(fps)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in rows} == brute_components(ids, linked)


def test_op6_equals_brute_force(spark, sf_dir, corpus):
    check_simhash(queries.op6_simhash(spark, sf_dir).collect(), corpus)


def test_simhash_of_near_copies_and_odd_texts(spark):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta eps zeta eta".split()) + str(rng.randrange(50)) for _ in range(300)]
    texts = list(ODD) + ["A b", "a B"]
    for _ in range(120):
        words = list(base)
        words[rng.randrange(300)] = "changed"
        texts.append(" ".join(words))
    got = simhash.near_duplicates(docs(spark, texts)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    check_simhash(got.collect(), dict(enumerate(texts)))
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_links_with_small_shards_keep_the_components(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(8):
        center = rng.getrandbits(64)
        for _ in range(40):
            v = center
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
            fps.add(v - (v >> 63 << 64))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for shard in (7, 2000):
        got = {r.node: r.component for r in components.connected_components(simhash.links(df, shard=shard, trees=3)).collect()}
        linked = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 2]
        want = brute_components(fps, linked)
        assert {f: got.get(f, f) for f in fps} == want


def test_bk_tree_finds_all_in_the_radius():
    rng = random.Random(5)
    values = np.array(sorted({rng.getrandbits(10) for _ in range(200)}), np.uint64)
    for radius in (0, 1, 2, 3):
        got = {(int(q), int(n)) for qs, ns in simhash.BKTree(values).search(values, radius) for q, n in zip(qs, ns, strict=True)}
        assert got == {(i, j) for i, a in enumerate(values.tolist()) for j, b in enumerate(values.tolist()) if (a ^ b).bit_count() <= radius}


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(70)] + [(5, 5), (200, 100), (100, 200), (300, 300)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 71)}, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_links(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, float) / np.linalg.norm(np.array(v, float)), label)
    ids = sorted(good)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= threshold]


def test_embedding_links(spark):
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(40):
            center = rng.normal(size=16)
            for _ in range(rng.integers(1, 30)):
                rows.append((n, (center + 0.05 * rng.normal(size=16)).tolist(), label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(5)]  # exact copies
    n += 5
    bad = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None], [], [float("inf")] + [1.0] * 15]
    rows += [(n + i, v, 0) for i, v in enumerate(bad)] + [(n + 10, rows[0][1], None), (n + 11, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    linked = brute_links(rows)
    want, count = brute_components([r[0] for r in rows], linked), Counter(i for pair in linked for i in pair)
    for cell in (2000, 150):
        got = {r.vec_id: r for r in neighbours.near_duplicates(df, cell=cell).collect()}
        assert got.keys() == want.keys()
        assert all(r.n_links <= count[i] for i, r in got.items())  # none is false
        assert sum(r.n_links for r in got.values()) >= 0.98 * sum(count.values())
        assert sum(got[i].component_id == c for i, c in want.items()) >= 0.99 * len(want)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_flat_graph_recall():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 1, 24)) + 0.08 * rng.normal(size=(60, 25, 24))
    x = x.reshape(-1, 24)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.93
    graph = neighbours.FlatGraph(x)
    for own in (np.arange(len(x)), np.full(len(x), -1)):
        found = np.zeros_like(true)
        for q, node in graph.search(x, own, 0.93):
            found[q, node] = True
        assert not (found & ~true).any()
        assert found.sum() >= 0.95 * true.sum()


# ---- classifiers ----


def test_op3_finds_toxic_documents(spark, sf_dir):
    rows = queries.op3_toxicity(spark, sf_dir).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(p == y for p, y in held) >= 0.8 * len(held)


def test_op3_precision_and_recall_of_held_out_toxic_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, sf_dir).where("held_out").collect()
    hit, toxic = [labels[r.doc_id] for r in rows if r.predicted and labels.get(r.doc_id) is not None], sum(labels.get(r.doc_id) == 1 for r in rows)
    assert toxic > 20 and sum(hit) >= 0.9 * toxic and sum(hit) >= 0.9 * len(hit)


def test_toxicity_sample_is_bounded_in_characters(spark):
    rows = [(i, "vile words here" if i % 2 else "kind words here", i % 2) for i in range(200)] + [(500, "vile " * 100_000, 0), (None, "vile", 1), (500, "vile " * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df, "toxic", chars=10_000)
    got = toxicity.score(df.withColumn("worst_sentence", F.lit("x")), model).collect()
    assert len(got) == len(rows) and all((r.score > 0.3) == (i % 2 == 1) for r, (i, _, y) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), rows[:200], strict=False))
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_locates_the_sentence(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        parts = [" ".join(rng.choices(words, k=6)) for _ in range(4)]
        if i % 3 == 0:
            parts[i % 4] += rng.choice([" vile", " foul"])
        rows.append((i, ". ".join(parts) + ".", int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df, "toxic")
    scored = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all((scored[i].score >= 0.3) == bool(y) for i, _, y in rows)
    assert all(scored[i].worst_sentence == i % 4 for i, _, y in rows if y)
    hit = toxicity.offending_sentences(df, model).collect()
    assert {(r.doc_id, r.sentence) for r in hit} == {(i, i % 4) for i, _, y in rows if y}
    odd = toxicity.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(r.score < 0.3 for r in odd)
    none = toxicity.fit(df.limit(0), df.select("doc_id", "toxic").limit(0), "toxic")
    assert all(abs(r.score - toxicity.PRIOR) < 1e-9 for r in toxicity.score(docs(spark, ["a b", None]), none).collect())


def test_op8_tells_languages(spark, sf_dir):
    rows = queries.op8_language(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_undetermined_languages(spark):
    train = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "der hund lief auf die straße", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    model = language.fit(train)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs(spark, [None, "", "123 !!", "die straße", "the mat\0x"]), model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert (got[3][0], got[4][0]) == ("de", "en")
    empty = language.fit(train.limit(0))
    assert language.predict(train, empty).where("lang_pred <> 'und'").count() == 0


# ---- rules ----


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_op10_equals_brute_force(spark, sf_dir, corpus):
    rows = {r.doc_id: r for r in queries.op10_quality(spark, sf_dir).collect()}
    assert rows.keys() == corpus.keys()
    for i, text in corpus.items():
        r, want = rows[i], brute_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    for name in ("op10_quality", "quality_ablations"):
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_quality_of_odd_rows(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, None, None), (2, "x " * 300_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted((r.doc_id or 0, r.n_words) for r in quality.measure(df).collect())
    assert got == [(0, 0), (1, 2), (1, 2), (2, 300_000)]
    with pytest.raises(ValueError):
        quality.measure(df, keep=True)
    assert quality.measure(df.limit(0)).count() == 0 and quality.ablations(quality.measure(df.limit(0))).where("n_failed > 0").count() == 0


def test_quality_of_odd_texts():
    for text in [*ODD, "a b c a b c", "x\nx\n\n \nx", "a b\x1cc", "a b a b a b a"]:
        assert quality.measure_text(text)[:5] == brute_quality(text)


def test_ablations(spark):
    ledger = quality.measure(docs(spark, ["word", "a b c " * 40, " ".join(f"good{i}" for i in range(80)), None]))
    rows = {r.rule: r for r in quality.ablations(ledger, "base-1").collect()}
    assert (rows["few_words"].n_failed, rows["few_words"].n_only, rows["few_words"].n_rejected) == (2, 2, 3)
    assert (rows["repeated_words"].n_failed, rows["repeated_words"].n_only) == (1, 1)
    assert [r.kept for r in quality.apply_policy(ledger, "base-1").orderBy("doc_id").collect()] == [False, False, True, False]


def brute_licenses(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def check_licenses(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_op7_equals_brute_force(spark, sf_dir, corpus):
    check_licenses(queries.op7_licenses(spark, sf_dir).collect(), corpus)


def test_license_texts(spark):
    texts = [*ODD, "CC-BY cc by CC BY-NC 4.0.", "xmit license, MIT License; mit licenses", "GNU General Public License gnu general public license" * 3, "Apache\nLicense, Version 2.0", "mit license " * 400, "ccby cc bye écc by"]
    rows = licenses.summarize(licenses.scan(docs(spark, texts))).collect()
    check_licenses(rows, dict(enumerate(texts)))
    labels = {r.doc_id: r.labels for r in rows}
    assert "cc-by-nc-4.0" in labels[len(ODD)] and "apache-2.0" in labels[len(ODD) + 3]


def test_license_labels(spark):
    """Versions with a plus sign, denials, exceptions, sentences of licenses."""
    cases = [
        ("Licensed under LGPL-2.1+ only here", {"lgpl-2.1-or-later"}),
        ("SPDX-License-Identifier: GPL-2.0+", {"gpl-2.0-or-later"}),
        ("This is not licensed under the MIT license.", {"mit"}),  # the base label stays
        ("It is not released under the Boost Software License.", set()),
        ("It is released under the ISC license, not the zlib license", {"isc"}),
        ("GPL-2.0 with the Classpath exception", {"gpl-2.0", "classpath-exception"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("SPDX-License-Identifier: MIT-0", {"mit-0"}),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", {"0bsd"}),
        ("c++ apache 2.0 text", {"apache-2.0"}),
    ]
    rows = licenses.summarize(licenses.scan(docs(spark, [t for t, _ in cases]))).collect()
    assert {r.doc_id: {x for x in r.labels.split(",") if x} for r in rows} == {i: labels for i, (_, labels) in enumerate(cases)}


def an_example(pattern):
    """A text that the pattern fits: first of alternatives, what is optional left out."""
    pattern = re.sub(r"\.\{\d,\d+\}\?", "x ", pattern).replace("x  ", "x ")
    while (shorter := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)([?*]?)", lambda m: "" if m[2] else m[1], pattern)) != pattern:
        pattern = shorter
    return re.sub(r" +", " ", re.sub(r".\?", "", re.sub(r"\[(.)[^]]*\]", r"\1", pattern.split("|")[0])).replace("\\d", "1").replace("\\b", "")).strip()


def test_license_sentences_pass_their_gates():
    scanner = licenses.scanner()
    assert len({r.name for r in scanner.rules}) == len(scanner.rules)
    named = {}
    for r in scanner.rules:
        named.setdefault((r.label, r.pattern), r)
    tables = licenses._PHRASES + licenses._SIGNATURES + licenses._EXCEPTIONS + signatures.SENTENCES + signatures.NAMES + signatures.EXCEPTIONS
    assert len(tables) > 250
    for label, pattern, keyword in tables:
        line = an_example(pattern)
        assert any(k in line for k in keyword.split("|")), (label, line)
        assert named[label, pattern].name in {r.name for _, _, r, _ in scanner.scan(line)[1]}, (label, line)


def test_license_keywords_are_in_each_alternative():
    """A pattern of alternatives holds a keyword in each of them."""
    for label, pattern, keyword in licenses._PHRASES + signatures.NAMES:
        for one in pattern.split("|") if "(" not in pattern else []:
            assert any(k in an_example(one) for k in keyword.split("|")), (label, one)


def test_license_versions_are_told_by_the_match():
    cases = [
        ("GNU Lesser General Public License version 3.0", {"lgpl-3.0"}),
        ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", {"gpl", "gpl-2.0-or-later"}),
        ("SPDX-License-Identifier: LGPL-2.1-only", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: AGPL-3.0-or-later", {"agpl-3.0-or-later"}),
        ("GPLv3", {"gpl-3.0"}),
        ("gpl 7", set()),
        ("PHP License 3.01", {"php-3.01"}),
        ("CC BY-NC-SA 2.5", {"cc-by", "cc-by-nc-sa-2.5"}),
        ("Tous droits réservés.", {"proprietary"}),
        ("Alle Rechte vorbehalten", {"proprietary"}),
        ("A plain sentence for use only on days when you may not be here.", set()),
    ]
    for text, want in cases:
        assert {r.label for _, _, r, hidden in licenses.scanner().scan(text)[1] if r.base or not hidden} == want, text


def test_rules_are_gated_soundly():
    """No rule can match where its keywords are absent."""
    scanner = licenses.scanner()
    assert len(scanner.rules) > 300
    samples = ["gnu lesser general public license version 2 1 or later", "spdx license identifier apache 2 0", "creativecommons org licenses by sa 4 0", "the 3 clause bsd license", "permission to use copy modify and or distribute this software for any purpose", "creative commons attribution share alike 3 0 unported"]
    for line in samples:
        direct = {i for i, p in enumerate(scanner.patterns) if p.search(line)}
        assert direct
        assert {r.name for _, _, r, _ in scanner.scan(line)[1]} == {scanner.rules[i].name for i in direct}


# ---- secrets and personal data ----


def test_secrets(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'some words token = "{h}" more words' for h in hexes]
    texts += [f"mail bob{i}.{i:02d}@mail.example.com and 12345678901234{i:02d} too" for i in range(60)]
    texts += ["plain text", "", None, f"key: {hexes[0]} twice {hexes[0]}"]
    df = docs(spark, texts)
    found = secrets.scan(df).cache()
    hit = {(r.doc_id, r.value) for r in found.where("is_secret").collect()}
    assert {(i, h) for i, h in enumerate(hexes)} <= hit
    assert not any(60 <= i < 120 for i, _ in hit)
    for r in found.collect():
        assert texts[r.doc_id][r.start : r.start + len(r.value)] == r.value
    clean = {r.doc_id: r.text for r in secrets.redact(df, found).collect()}
    assert len(clean) == len(texts) and all(h not in (t or "") for h, t in zip(hexes[1:], [clean[i] for i in range(1, 60)], strict=True))
    assert [clean[i] for i in range(60, 122)] == texts[60:122]
    assert clean[122] is None
    assert secrets.scan(docs(spark, ["a"]).limit(0)).count() == 0


def test_op2_finds_the_tokens(spark, sf_dir):
    import re

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smaller one holds none
    corpus = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    hit = {(r.doc_id, r.value) for r in queries.op2_secrets(spark, sf_dir).where("is_secret").collect()}
    planted = {(i, m) for i, t in corpus.items() for m in re.findall(r'token = "([0-9a-f]{40})"', t or "")}
    assert planted and planted <= hit
    assert not any("@" in v or v.isdigit() for _, v in hit)


PII = [
    "call +1 (456) 555-2186 or +1 (456) 555 2186, write to Bob.Smith@Mail.example.com",
    "bob.smith@mail.example.com pays with 4111 1111 1111 1111 or 4111-1111-1111-1111",
    "Mrs. Anna Miller met Herr Schmidt at 10.1.2.30; ssn 123-45-6789, DE89 3704 0044 0532 0130 00",
    "Госпожа Иванова",
    "nothing here 12 v1.2.3",
    "",
    None,
]


def test_surrogates(spark):
    df = docs(spark, PII).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in surrogates.surrogate(df, "k").collect()}
    assert len(got) == len(PII)
    assert [got[i].n_entities for i in range(7)] == [3, 3, 5, 1, 0, 0, 0]
    assert [got[i].text for i in (4, 5, 6)] == PII[4:]
    import re

    first, second, third = (got[i].text for i in range(3))
    phones = re.findall(r"\+1 \(\d{3}\) 555|\+1 \((\d{3})\) (\d{3})[ -](\d{4})", first)
    assert len(phones) == 2 and phones[0] == phones[1] and "2186" not in first
    mail = re.search(r"\S+@\S+$", first)[0]
    assert second.startswith(mail + " ") and mail.endswith(".com") and "smith" not in second.lower()
    cards = [c.replace(" ", "").replace("-", "") for c in re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", second)]
    assert len(cards) == 2 and cards[0] == cards[1] != "4111111111111111"
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(cards[0])) % 10 == 0
    assert third.startswith("Mrs. ") and "Miller" not in third and "Herr " in third and "10.1.2.30" not in third
    assert re.fullmatch(r"Госпожа [а-яА-ЯёЁ]+", got[3].text) and "Иванова" not in got[3].text
    assert {r.text for r in surrogates.surrogate(df, "other").collect()} != {r.text for r in got.values()}


def test_surrogates_stay_distinct(spark):
    values = spark.range(900).select(F.lit("ssn").alias("kind"), F.format_string("%d", F.col("id") % 90 + 10).alias("value"), F.lit(None).cast("string").alias("gender"))
    names = surrogates.assign(values.where("value < 40"), "k").collect()
    assert len(names) == 30 and len({r.surrogate for r in names}) == 30
    assert not {r.surrogate for r in names} & {r.value for r in names}


def test_op4_leaves_no_planted_entity(spark, sf_dir, corpus):
    import re

    pattern = r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b"
    rows = {r.doc_id: r for r in queries.op4_pii(spark, sf_dir).collect()}
    assert rows.keys() == corpus.keys()
    real = {m for t in corpus.values() for m in re.findall(pattern, t or "")}
    assert real and not any(m in (rows[i].text or "") for i, t in corpus.items() for m in re.findall(pattern, t or ""))


# ---- pipeline ----


def test_pipeline(spark, sf_dir, corpus):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    left = {r.doc_id for r in out}
    ids = sorted(i for i, t in corpus.items() if not quality_fails(t))
    grams = {i: set(zip(*[text_words(corpus[i])[k:] for k in range(5)])) for i in ids}
    roots = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 9 * len(grams[a] & grams[b]) >= 4 * (len(grams[a]) + len(grams[b]))])
    assert left == {i for i in ids if roots[i] == i}
    assert {"doc_id", "text", "lang", "source", "n_chars"} == set(docs_.columns)


def quality_fails(text):
    m = dict(zip(quality.MEASURES, quality.measure_text(text), strict=True))
    return any(eval(r.fails.replace(" OR ", " or ").replace(" AND ", " and ").replace(" = ", " == "), {}, m) for r in quality.RULES)


def test_toxicity_passes_over_a_text_above_the_bound(spark):
    rows = [(i, "vile words here" if i % 2 else "kind words here", i % 2) for i in range(200)]
    order = spark.createDataFrame(rows, DOCS + ", toxic int").orderBy(F.xxhash64("doc_id")).select("doc_id").collect()
    first = order[0].doc_id
    df = spark.createDataFrame([(i, "long " * 1_000_000 if i == first else t, y) for i, t, y in rows], DOCS + ", toxic int")
    assert toxicity.fit(df, df, "toxic", chars=100_000).weights
