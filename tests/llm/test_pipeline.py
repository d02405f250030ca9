import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from docgrid.llm.common import documents
from docgrid.llm.decontam import edit_search

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage."""
    from docgrid.llm.common import cut

    docs, out = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        new, _ = cut(stage(spark, docs, SF), name)
        out.append((docs, new))
        docs = new
    return {name: x for (name, _), x in zip(corpus_pipeline.STAGES, out)}


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_run(spark, stages):
    names = documents(spark, SF).columns
    assert all(after.columns == names for name, (_, after) in stages.items() if name != "bpe")
    last = stages["bpe"][1]
    assert sorted(map(str, corpus_pipeline.run(spark, SF).drop("ids").collect())) == sorted(map(str, last.drop("ids").collect()))


def test_quality(spark, stages):
    before, after = (texts(x) for x in stages["quality"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [(r.doc_id in after) == (r.quality == 1) for r in labels if r.doc_id in before]
    assert np.mean(right) > 0.95


def test_exact(stages):
    before, after = (texts(x) for x in stages["exact_dedup"])
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
    assert set(after) == set(first.values())


def test_near(stages):
    before, after = (texts(x) for x in stages["ngram_join"])
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, words_of(t)) for i, t in before.items())}
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(before)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if find(i) == i}


def test_benchmark(spark, stages):
    before, after = (texts(x) for x in stages["decontamination"])
    norm = lambda t: b" ".join(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()).split())
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, t in before.items() if any(x in norm(t) or (len(t) < 1500 and edit_search(x, norm(t), len(x) // 10)[1] >= 0) for x in items)}
    assert bad and not bad & set(after)
    extra = set(before) - set(after) - bad  # found in longer texts, by a few edits
    assert all(any(edit_search(x, norm(before[i]), len(x) // 10)[1] >= 0 for x in items) for i in extra)


def test_tokens(stages):
    import public_tokenizers
    import tiktoken

    from docgrid.llm.bpe import load_ranks

    before, after = stages["bpe"]
    ranks = load_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = texts(before)
    rows = after.collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = oracle.encode_ordinary(want[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((want[r.doc_id] or "").encode()).hexdigest()


def test_null_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", 0.5, 3), (2, "", None, None, None), (None, "a b c d e f", "x", 0.1, 1), (3, "A b c d e f", "x", 0.1, 1)], "doc_id long, text string, id string, score double, row int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert stages_count(spark, docs) == 4


def stages_count(spark, docs):
    return corpus_pipeline.tokens(spark, docs, SF).count()
