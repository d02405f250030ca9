import numpy as np

from docgrid.llm import quality
from docgrid.llm.quality import fit, score_documents, train


def corpus(spark, n=400):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        w = rng.choice(words, 60)
        rows.append((i, " ".join(w) + "." if good else "%%% ".join(w), "x"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    ranker = train(docs, labels.where("doc_id % 3 != 1"))
    got = {r.doc_id: r for r in score_documents(docs, ranker).collect()}
    held = [r for r in labels.where("doc_id % 3 = 1").collect()]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (4, "w " * 1_500_000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (4, 7)], "doc_id long, quality int")
    ranker = train(docs, none)
    assert {r.score for r in score_documents(docs, ranker).collect()} == {0.5}
    assert score_documents(docs.limit(0), ranker).count() == 0
    x = np.random.default_rng(0).normal(size=(50, 5))
    y = (x[:, 0] > 0).astype(int)
    r = fit(x, y)
    assert ((r.score(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_threshold_is_over_all_labelled_rows(spark):
    """Classes overlap and the sample is capped: the share put down as poor stays the labels' own."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("%%%" if rng.random() < (0.3 if i % 5 else 0.45) else "word" for _ in range(40))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, _ in rows] + [(9999, 0)], "doc_id long, quality int")
    for cap in (30, 200, 8000):
        ranker = train(docs, labels, per_class=cap)
        raw = np.sort([np.log(r.score / (1 - r.score)) for r in score_documents(docs, ranker).collect()])
        assert raw[119] <= 1e-9 and raw[120] >= -1e-9, cap  # 120 of 600 are poor


def test_counts_in_pieces_and_lines(monkeypatch):
    texts = ["", "ab\nab\n\u00e9x", "", "z" * 40, "one two\n" * 30, ""]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    whole = quality.features(np.frombuffer(b"".join(data), np.uint8), offsets)
    for size in (1, 7, 40):
        monkeypatch.setattr(quality, "CHUNK", size)
        assert np.array_equal(whole, quality.features(np.frombuffer(b"".join(data), np.uint8), offsets))
    for row, t in zip(whole, data):
        lone = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.array_equal(row, lone[0])
        lines = t[:-1].split(b"\n") if t else []
        assert np.isclose(row[quality.NAMES.index("line_repeats")], 1 - len(set(lines)) / len(lines) if lines else 0)
