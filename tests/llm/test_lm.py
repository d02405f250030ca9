import math
import re
from collections import Counter

import numpy as np
import pytest

from docgrid.llm import lm


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def corpus(seed=1, n=160):
    rng = np.random.default_rng(seed)
    kinds = [[f"w{i}{end}" for i in range(80)] for end in ("tion", "heit", "que", "ado")]
    rows = []
    for i in range(n):
        k = kinds[i % 4]
        rows.append((i, " ".join(rng.choice(k, int(rng.integers(20, 120)))) + (" Rare%d" % i if i % 3 == 0 else "")))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "unseen words only"), (3, rows[3][1]), (None, "W1tion")]


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, c int").repartition(3)
    old, lm.HEAD = lm.HEAD, 40  # the rest goes by the join
    try:
        model, counts, _ = lm.train(docs.where("doc_id % 10 != 0"))
        out = lm.score_documents(docs, model, counts).collect()
    finally:
        lm.HEAD = old
    return rows, model, out


def test_base_against_brute_force(scored):
    rows, model, out = scored
    train = Counter(w for i, t in rows if i is not None and i % 10 for w in words_of(t))
    n, v = sum(train.values()), len(train)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    want = sorted((str(i), len(words_of(t)), sum(train[w] > 0 for w in words_of(t)), round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words_of(t)), 6)) for i, t in rows)
    assert sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want


def test_model_beats_counts_on_held_out_texts(scored):
    _, _, out = scored
    held = [r for r in out if r.id is not None and r.id % 10 == 0 and r.id < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_probabilities_add_up(scored):
    rows, model, _ = scored
    data = np.frombuffer(b"w1tion w2tion w3heit", np.uint8)
    tok, cls, at = lm.tokens(data, np.array([0, len(data)]))
    p = lm.class_probabilities(model.weights, lm.contexts(tok, cls, at))
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    # within a class: seen words and one unseen
    k = int(cls[0])
    train = Counter(w for i, t in rows if i is not None and i % 10 for w in words_of(t) if w)
    own = {w: c for w, c in train.items() if lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[1][0] == k}
    whole = model.class_tokens[k] + 0.1 * (model.class_words[k] + 1)
    assert len(own) == model.class_words[k] and math.isclose(sum((c + 0.1) / whole for c in [*own.values(), 0]), 1)


def test_score_against_plain_loop(scored):
    rows, model, out = scored
    by = {r.id: r for r in out}
    train = Counter(w for i, t in rows if i is not None and i % 10 for w in words_of(t))
    for i, t in rows[:6]:
        data = np.frombuffer(t.encode(), np.uint8)
        tok, cls, at = lm.tokens(data, np.array([0, len(data)]))
        feats, total = lm.contexts(tok, cls, at), 0.0
        for w, k, f in zip(words_of(t), cls, feats):
            x = model.weights[f].astype(float).sum(0)
            total += math.log10(math.exp(x[k] - x.max()) / np.exp(x - x.max()).sum())
            total += math.log10((train[w] + 0.1) / (model.class_tokens[k] + 0.1 * (model.class_words[k] + 1)))
        assert math.isclose(total, by[i].score, rel_tol=1e-4)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model, counts, _ = lm.train(docs.limit(0))
    out = lm.score_documents(docs, model, counts).collect()
    assert {(r.id, r.n_tokens, r.n_known, r.base_score) for r in out} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}
    model, counts, _ = lm.train(docs)
    assert lm.score_documents(docs.limit(0), model, counts).count() == 0


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(lm, "LOT", 700)
    monkeypatch.setattr(lm, "STEP", 256)
    monkeypatch.setattr(lm, "BATCH", 64)
    docs = spark.createDataFrame([*corpus(3, 60), (950, "w1tion " * 5000)], "doc_id long, text string")
    first = None
    for parts in (1, 2, 7):
        given = docs.repartition(parts)
        model, counts, _ = lm.train(given)
        got = sorted((str(r.id), r.n_tokens, r.score) for r in lm.score_documents(given, model, counts).collect())
        first = first or got
        assert got == first


def test_words_that_a_polynomial_would_confuse(spark):
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    model, _, _ = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert model.vocabulary == 3


def test_words_that_one_lane_would_confuse(spark):
    rows = [(1, "abcdefghijklmnop x y"), (2, "p9jqf07o<$p2y+<y x y")]
    model, _, _ = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.vocabulary == 5
