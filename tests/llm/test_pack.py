import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docgrid.llm import pack, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ORACLE = Tokenizer.from_file(PATH)
ENCODER = pack.Encoder(open(PATH, "rb").read())


def ids_of(text):
    return ORACLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'é\n\t\x1f\xa0.3", max_size=120), st.lists(st.sampled_from([" ", "  ", "\n", "it's", "fox", " \n ", "<|endoftext|>", "x" * 70])).map("".join)))
def test_units_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)


def by_rounds(total, weight, size, least):
    """The queues' tokens in order, as (queue, token): counters that grow by a quantum each round."""
    quantum = [Fraction(size * w, sum(weight)) for w in weight]
    every = [max(1, -(-least // q)) for q in quantum]
    n = len(total)
    phase = [j * e // n for j, e in enumerate(every)]
    counter, given_, out, r = [Fraction(0)] * n, [0] * n, [], 0
    while sum(given_) < sum(total):
        for j in [(r + i) % n for i in range(n)]:
            if (r + 1 + phase[j]) % every[j] == 0:  # the counter holds at least `least`
                counter[j] += every[j] * quantum[j]
                take = min(int(counter[j]), total[j] - given_[j])
                out += [(j, given_[j] + i) for i in range(take)]
                given_[j] += take
                counter[j] -= take
        r += 1
    return out


@pytest.mark.parametrize("total,weight,size,least", [
    ([900, 300, 41], [8, 4, 4], 64, 1), ([500, 500], [1, 1], 32, 20), ([7], [3], 16, 4), ([1000, 10, 700, 3], [1, 1, 4, 2], 64, 30), ([64, 128], [1, 3], 16, 1), ([300, 1, 1, 90], [32, 1, 1, 30], 64, 16),
])
def test_closed_form_equals_rounds(total, weight, size, least):
    schedule = pack.Schedule(np.array(total), np.array(weight, float), size, least)
    want = by_rounds(total, weight, size, least)
    at = {x: p for p, x in enumerate(want)}
    rng = np.random.default_rng(1)
    queue, first, n = [], [], []
    for j, t in enumerate(total):  # documents of random lengths
        i = 0
        while i < t:
            k = min(int(rng.integers(1, 60)), t - i)
            queue, first, n, i = [*queue, j], [*first, i], [*n, k], i + k
    of, start, length, place = schedule.pieces(np.array(queue), np.array(first), np.array(n))
    seen = set()
    for d, s, k, p in zip(of, start, length, place):
        assert k > 0 and p // size == (p + k - 1) // size
        for i in range(k):
            assert at[queue[d], first[d] + s + i] == p + i
            seen.add(p + i)
    assert seen == set(range(sum(total)))
    joined = sorted(zip(of, start, length, place))
    for a, b in zip(joined, joined[1:]):  # pieces are as long as they can be
        assert a[0] != b[0] or a[3] + a[2] != b[3] or b[3] % size == 0


def check(rows, docs, size=2048):
    """Pieces against the library, document by document."""
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert {*pieces} == {d for d, *_ in docs}
    for d, text, *_ in docs:
        ids = [*ids_of(text or ""), 1]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in range(len(seqs)):
        at = 0
        for r in sorted(seqs[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or s == len(seqs) - 1


def test_table(spark):
    long = "word and " * 9_000
    rows = [(i, f"text {i} of a source, " * (i % 40), f"s{i % 5 if i % 3 else 0}", "x") for i in range(300)]
    rows += [(1000, None, "s1", None), (1001, "", None, None), (1002, long, None, None), (None, " \n ", "s2", None), (1003, "é" * 3_000, "s3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string").repartition(3)
    out = pack.pack_documents(docs, PATH, size=256, least=32, keep_ids=True).withColumnRenamed("id", "doc_id").cache()
    check(out.collect(), rows, 256)
    made = {r.sequence_id: r for r in pack.sequences(out, 256).collect()}
    last = max(made)
    assert all(len(r.ids) == 256 and sum(r.lengths) == 256 for s, r in made.items() if s != last)
    n = sum(made[last].lengths)
    assert len(made[last].ids) in ({n} if n & (n - 1) == 0 else {256})
    assert pack.pack_documents(docs.limit(0), PATH).count() == 0


def test_repeated_rows_and_ids(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(1, "other", "t")] * 3, "doc_id long, text string, source string")
    out = pack.pack_documents(docs, PATH, size=64, least=8).collect()
    assert sum(r.length for r in out) == 50 * (len(ids_of("a b c")) + 1) + 3 * (len(ids_of("other")) + 1)
    assert sorted((r.sequence_id, r.offset + i) for r in out for i in range(r.length)) == [(p // 64, p % 64) for p in range(sum(r.length for r in out))]


def test_windows_have_the_mixture(spark):
    rows = [(i, "a plain text of some words " * (5 + i % 50), "big" if i % 3 else ("mid" if i % 2 else "low")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = pack.pack_documents(docs, PATH, size=512, least=64).groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()
    total = {}
    for r in out:
        total[r.source] = total.get(r.source, 0) + r.n
    every = sum(total.values())
    windows = every // 512
    for source, t in total.items():
        by = {r.sequence_id: r.n for r in out if r.source == source}
        given_ = 0
        for k in range(windows):
            given_ += by.get(k, 0)
            assert abs(given_ - (k + 1) * 512 * t / every) <= 64 + 512 * t / every + 8


def test_target_mixture_until_a_source_ends(spark):
    rows = [(i, "some words here " * 20, "a" if i % 2 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pack.pack_documents(docs, PATH, size=256, target={"a": 3, "b": 1}, least=32)
    half = out.where(F.col("sequence_id") < out.agg(F.max("sequence_id")).first()[0] // 2).groupBy("source").agg(F.sum("length").alias("n")).collect()
    share = {r.source: r.n for r in half}
    assert abs(share["a"] / (share["a"] + share["b"]) - 0.75) < 0.01
    with pytest.raises(ValueError):
        pack.pack_documents(docs, PATH, target={"a": 0})


def test_sources_beyond_the_queues(spark, monkeypatch):
    monkeypatch.setattr(pack, "QUEUES", 4)
    rows = [(i, "words " * (i % 30), f"s{i % 19}" if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    check(pack.pack_documents(docs, PATH, size=128, least=16).withColumnRenamed("id", "doc_id").collect(), rows, 128)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.op11_pack(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    check(out.collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
