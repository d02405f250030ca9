"""Joins without all pairs against all pairs."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrid.operators import nearest, phrases, similarity


def no_nested_loop(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    return df


def expected(texts, words, bounds):
    out = set()
    for k, t in texts:
        for p in {p for p in words if p}:
            at = [m.start() for m in re.finditer(rf"(?=\b{re.escape(p)}\b)" if bounds else f"(?={re.escape(p)})", t or "")]
            if at:
                out.add((k, p, at[0], len(at)))
    return out


@pytest.mark.parametrize("bounds", [True, False])
@pytest.mark.parametrize("most", [phrases.DICTIONARY_CHARS, 10])
def test_phrases_equal_expressions(spark, bounds, most):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé-.' _9") for _ in range(rng.randrange(1, 7)))
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 25)))) for i in range(80)] + [(900, None), (901, "")]
    words = [word() for _ in range(150)] + ["a b", "", None, "é", "a", "a"]
    df, dictionary = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in words], "phrase string")
    got = no_nested_loop(phrases.phrase_hits(df, dictionary, "id", bounds=bounds, most=most)).collect()
    assert {tuple(r) for r in got} == expected(texts, words, bounds) and len(got) == len({tuple(r)[:2] for r in got})


def test_ten_thousand_phrases_in_one_pass(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    words = sorted({" ".join(rng.sample(vocabulary, 2)) for _ in range(10_500)})[:10_000]
    texts = [(i, " ".join(rng.choice(vocabulary) if rng.random() < 0.6 else rng.choice(words) for _ in range(60))) for i in range(60)]
    df, dictionary = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in words], "phrase string")
    out = no_nested_loop(phrases.phrase_hits(df, dictionary, "id"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r.id, r.phrase) for r in out.collect()} == {(i, p) for i, t in texts for p in words if p in t and re.search(rf"\b{p}\b", t)}


@pytest.mark.parametrize("metric,least", [("EDIT", 90), ("EDIT", 75), ("EDIT", 30), ("FUZZY", 92), ("FUZZY", 85), ("FUZZY", 60)])
def test_pairs_equal_all_pairs(spark, metric, least, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = random.Random(least)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([1, 3, 6, 9, 14, 30, 60]))) for _ in range(40)]

    def edit(x):
        for _ in range(rng.randrange(0, 1 + len(x) // 4)):
            i = rng.randrange(0, len(x) + 1)
            x = x[:i] + rng.choice(["", "a", "e"]) + x[i + rng.randrange(0, 2) :]
        return x

    texts = [(i, edit(rng.choice(base))) for i in range(160)] + [(500, ""), (501, None), (502, "é"), (503, base[5]), (504, base[5])]
    chosen = getattr(similarity, metric)
    got = no_nested_loop(similarity.similar_pairs(spark.createDataFrame(texts, "id int, x string"), "id", "x", least, chosen)).collect()
    pairs = [(a, b, s or "", t or "") for i, (a, s) in enumerate(texts) for b, t in texts[i + 1 :]]
    scored = spark.createDataFrame(pairs, "a int, b int, s string, t string").select("a", "b", chosen.score(F.col("s"), F.col("t")).alias("score")).where(F.col("score") >= least)
    want = {tuple(r) for r in scored.collect() if r.score >= least}
    both = {(a, b, 100) for a, b, s, t in pairs if s == t}  # two empty texts are alike by either metric
    assert {tuple(r) for r in got} == {w for w in want if (w[0], w[1], 100) not in both} | both and len(got) == len({(r.a, r.b) for r in got})


def plain_top(rows, asked, k):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v is not None and None not in v and any(v) and len(v) == 6}
    out = set()
    for q in asked:
        if q in unit:
            ranked = sorted(((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q))[:k]
            out |= {(q, i, p + 1) for p, (_, i) in enumerate(ranked)}
    return out


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-9, 10, 6).astype(float).tolist()) for i in range(300)] + [(1000, None), (1001, [0.0] * 6), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1003, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [i for i, _ in rows if i % 10 == 0]
    for block in (nearest.BLOCK_BYTES, 1000):  # one block of queries, and several
        monkeypatch.setattr(nearest, "BLOCK_BYTES", block)
        out = no_nested_loop(nearest.cosine_top(df, df.where("vec_id % 10 = 0"), 7))
        got = {(r.q, r.id, r.place) for r in out.withColumn("similarity", F.round("similarity", 9)).collect()}
        want = plain_top(rows, asked, 7)
        assert len(got) == len(want) and len(got ^ want) <= 0.05 * len(want)  # equal similarities may round apart
    assert nearest.cosine_top(df.limit(0), df.limit(0), 3).count() == 0


def test_nearest_holds_few_products():
    """Queries of a block times vectors of a batch would be 134 MB, several times over."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 8))
    ids = pa.array(np.arange(len(x)))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.float64()))], names=["id", "v"])
    block = SimpleNamespace(value=(ids, x / np.linalg.norm(x, axis=1)[:, None]))
    tracemalloc.start()
    rows = sum(b.num_rows for b in nearest._scores(block, 3, None)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3 * len(x) and peak < 100 << 20


def test_recall_of_lists(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lists = nearest.fit_lists(df, 40, 8)
    assert nearest.recall(df, df.where("vec_id % 100 = 0"), 10, lists) >= 0.9
    assert nearest.recall(df, df.where("vec_id % 100 = 0"), 10, nearest.Lists(lists.centroids, 40)) == 1.0


@pytest.mark.parametrize("bounds", [True, False])
def test_a_large_dictionary_sends_its_hits_only(spark, bounds, monkeypatch):
    """Phrases that begin alike: what goes to the exchange grows with the hits, not with texts times phrases."""
    names = [f"supplier#{i:05d}" for i in range(400)] + ["é ü", "a b", "aa"]
    rows = [(i, f"x supplier#{i:05d}, é ü Supplier#1 aaaa") for i in range(300)] + [(900, None), (901, ""), (902, "supplier#0000"), (903, "a b\na b aa")]
    df, dictionary = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(n,) for n in names], "phrase string")
    monkeypatch.setattr(phrases, "BITS", 1 << 16)
    sent = []
    real = phrases._likely
    monkeypatch.setattr(phrases, "_likely", lambda *a: sent.append(real(*a)) or sent[-1])
    got = {tuple(r) for r in phrases.phrase_hits(df, dictionary, "id", bounds=bounds, most=10).collect()}
    assert got == {tuple(r) for r in phrases.phrase_hits(df, dictionary, "id", bounds=bounds).collect()}
    assert df.mapInArrow(sent[0], "key int, phrase string, at int, n int").count() <= 2 * len(got)


@pytest.mark.parametrize("query", ["openings_first_label", "writing_companies"])
def test_queries_over_a_large_dictionary(spark, query, monkeypatch):
    """The same rows when the dictionary counts as large, and no exchange of texts with all phrases that begin alike."""
    import __spark_entry__ as entry

    want = entry.queries()[query](spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(phrases.phrase_hits, "__defaults__", ("text", "phrase", True, 10))
    df = entry.queries()[query](spark, "/root/testdata/sf0.001")
    assert "collect_set(phrase" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, df.collect())) == sorted(map(str, want))


@pytest.mark.parametrize("first", [1, 8])
def test_first_label_sends_few(spark, first, monkeypatch):
    """Of a text with many phrases only the first likely ones are sent; those of which none is a phrase are looked up whole."""
    names = [(None if i % 5 == 4 else "xyz"[i % 3], f"supplier#{i:05d}") for i in range(400)] + [("y", "a b"), ("x", "a b"), ("z", "é ü")]
    rows = [(i, " ".join(f"supplier#{(7 * i + k) % 500:05d}" for k in range(i % 40)) + " é ü a b"[: i % 9]) for i in range(200)] + [(900, None), (901, "")]
    df, dictionary = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(names, "label string, phrase string")
    by_text = {}
    for label, p in names:
        by_text.setdefault(p, []).append(((label is None, label or ""), label))
    want = set()
    for k, t in rows:
        hits = sorted((*x, p) for p, some in by_text.items() if t and re.search(rf"\b{re.escape(p)}\b", t) for x in some)
        want |= {(k, *hits[0][1:])} if hits else set()
    monkeypatch.setattr(phrases, "FIRST", first)
    monkeypatch.setattr(phrases, "BITS", 1 << (12 if first == 1 else 27))  # a small bitmap lets many wrong ones through
    sent = []
    real = phrases._first_likely
    monkeypatch.setattr(phrases, "_first_likely", lambda *a: sent.append(real(*a)) or sent[-1])
    got = [tuple(r) for r in phrases.first_hits(df, dictionary, "id", most=10).collect()]
    assert set(got) == want and len(got) == len(want)
    assert df.mapInArrow(sent[0], "key int, no int, phrase string, more boolean").groupBy("key").count().where(f"count > {first}").isEmpty()
    assert {tuple(r) for r in phrases.first_hits(df, dictionary, "id").collect()} == want
