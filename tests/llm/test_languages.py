"""The kernel against brute force; steady scores; any number of languages."""

import pickle
import random
import tracemalloc

import numpy as np
import pandas as pd

from stackloom.llm import language


def brute_grams(text):
    letters, gap = [], False
    out = set()
    for c in text.lower():
        if c.isalpha():
            letters.append(c)
            gap = True
        elif gap:
            letters.append(" ")
            gap = False
    for n in range(1, language.MAX_N + 1):
        out |= {"".join(letters[i : i + n]) for i in range(len(letters) - n + 1)}
    return out


def learn(rows, landmarks):
    """A model of rows with columns text and lang: the first of each language give landmarks."""
    chosen = [t for k in sorted(set(rows["lang"])) for t in rows.loc[rows["lang"] == k, "text"].tolist()[:landmarks]]
    marks = language.Marks([language.drawn_segment(t, 0) for t in chosen])
    return language.regress(language.kernels(rows["text"].tolist(), marks), rows["lang"].tolist(), marks)


def test_presences_equal_brute_force():
    texts = ["The cat, 12 sat!", "", None, "über   die Straße", "кот 猫 кот", "a\0b", "zzz"]
    marks = ["the straße", "кот sat"]
    symbol, row = language.symbols(marks)
    known = np.unique(np.concatenate([g for g, _ in language.grams(symbol, row)]))
    names = ["".join(chr(int(k) >> s & (1 << 21) - 1) for s in (42, 21, 0) if int(k) >> s) for k in known]
    assert set(names) == brute_grams(marks[0]) | brute_grams(marks[1])
    index = language.Index(known)
    plain = language.Index(known)
    plain.table = None  # looked up by search
    symbol, row = language.symbols(texts)
    for how in (index, plain):
        of, gram = how.presences(symbol, row, len(texts))
        for i, t in enumerate(texts):
            got = [names[g] for g in gram[of == i].tolist()]
            assert len(got) == len(set(got)) and set(got) == brute_grams(t or "") & set(names)


def test_kernel_ridge_against_brute_force(monkeypatch):
    rng = random.Random(3)
    words = {"aa": "kala mitu rosa", "bb": "stern wolke feuer", "cc": "дом река лес"}
    rows = pd.DataFrame([(" ".join(rng.choices(words[k].split(), k=8)), k) for _ in range(12) for k in words], columns=["text", "lang"])
    model = learn(rows, 4)
    sets = [brute_grams(t) for t in rows["text"]]
    chosen = [i for k in words for i in [j for j in range(len(rows)) if rows["lang"][j] == k][:4]]
    known = set().union(*[sets[i] for i in chosen])
    kernel = lambda a, b: len(a & b & known) / max(1, np.sqrt(len(a & known) * len(b & known)))
    mm = np.array([[kernel(sets[i], sets[j]) for j in chosen] for i in chosen])
    value, vector = np.linalg.eigh(mm)
    good = value > 1e-6 * value.max()
    nystroem = vector[:, good] / np.sqrt(value[good])
    z = np.array([[kernel(s, sets[j]) for j in chosen] for s in sets]) @ nystroem
    y = np.array([[k == lang for k in sorted(words)] for lang in rows["lang"]], float)
    w = (1 / y.sum(0)) @ y.T
    a = z.T @ (z * w[:, None])
    beta = np.linalg.solve(a + language.RIDGE * 3 / len(a) * np.eye(len(a)), z.T @ (y * w[:, None]))
    want = np.clip((z @ beta).max(1), 0, 1)
    names, scores = model.scorer()(rows["text"].tolist())
    assert names == rows["lang"].tolist() and np.allclose(scores, want, atol=2e-3)
    # through the landmarks, a few sums at a time, as with the weights added beforehand
    monkeypatch.setattr(language, "_FOLD", 0)
    monkeypatch.setattr(language, "_SUMS", 5)
    again, same = model.scorer()(rows["text"].tolist())
    assert again == names and np.allclose(same, scores, atol=1e-6)


def test_fit_learns_from_whole_texts(spark):
    rng = random.Random(8)
    words = {"aa": ["kala", "mitu", "rosa", "tolu"], "bb": ["stern", "wolke", "feuer", "abend"]}
    rows = [(i, " ".join(rng.choices(words["ab"[i % 2] * 2], k=(5, 4_000)[i % 3 == 0])), "ab"[i % 2] * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ordered = df.selectExpr("*", "xxhash64(doc_id) AS h").orderBy("h").toPandas()
    chosen = [r for k in ("aa", "bb") for r in ordered[ordered["lang"] == k].head(5).itertuples()]
    marks = language.Marks([language.drawn_segment(r.text, r.h) for r in chosen])
    want = language.regress(language.kernels(ordered["text"].tolist(), marks), ordered["lang"].tolist(), marks)
    got = language.fit(df, landmarks=5)
    assert got.languages == want.languages and np.array_equal(got.marks.known, marks.known)
    assert np.allclose(got.scorer()(ordered["text"].tolist())[1], want.scorer()(ordered["text"].tolist())[1], atol=1e-3)
    # a word that stands at the end of long texts alone is learned from
    tail = [(i, t + " zqzqzq" * 2_000 if k == "aa" and len(t) > 1_000 else t, k) for i, t, k in rows]
    model = language.fit(spark.createDataFrame(tail, df.schema), landmarks=10)
    assert model.scorer()(["zqzqzq zqzqzq"])[0] == ["aa"]


def test_memory_of_many_scripts(spark):
    rng = random.Random(6)
    rows = []
    for k in range(100):
        letters = [c for c in map(chr, range(0x4E00 + 200 * k, 0x4E00 + 200 * k + 40))]
        words = ["".join(rng.choices(letters, k=4)) for _ in range(300)]
        rows += [(100 * k + i, " ".join(rng.choices(words, k=400)), f"l{k:03}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    tracemalloc.start()
    model = language.fit(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.marks.n <= language.ALL_LANDMARKS and len(model.marks.known) > 100_000
    assert peak < 400e6 and len(pickle.dumps(model)) < 50e6
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_long_texts_score_as_short_ones(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = language.fit(df).scorer()
    prose = " ".join(r.text for r in df.where("lang = 'en' AND length(text) > 300").select("text").collect())
    long = (prose * (1 + 1_000_000 // len(prose)))[:1_000_000]
    (a, b), (x, y) = score([prose[:3000], long])
    assert a == b == "en" and abs(x - y) < 0.2 and y > 0.5


def test_any_number_of_languages(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèñ") for _ in range(5)) for _ in range(6)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=30)), f"l{k:03}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert len(model.languages) == 150
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)


def test_odd_rows_and_columns(spark):
    train = spark.createDataFrame([(i, "the cat sat" if i % 2 else "der hund lief", "en" if i % 2 else "de") for i in range(8)] + [(None, "the cat", "en"), (9, None, "en"), (10, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    rows = [(1, "the cat", 0.5), (1, "the cat", 0.5), (None, "der hund", None), (2, "", 1.0), (3, "der hund " * 100_000, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other double")
    got = language.predict(df, model, keep=True).collect()
    assert sorted((r.doc_id or 0, r.other or 0, r.lang_pred) for r in got) == [(0, 0, "de"), (1, 0.5, "en"), (1, 0.5, "en"), (2, 1.0, "und"), (3, 2.0, "de")]
    assert language.predict(df.limit(0), model).count() == 0
    # languages that fit alike: the first in order
    same = learn(pd.DataFrame([("aba", "y"), ("aba", "x")], columns=["text", "lang"]), 1)
    assert same.scorer()(["aba"])[0] == ["x"]
