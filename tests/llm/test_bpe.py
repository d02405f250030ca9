import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(open(PATH, "rb").read())
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab 'é\n", max_size=200)))
def test_equals_tiktoken(text):
    ids = CODEC.encode(text)
    assert [int(x) for x in ids.split()] == ORACLE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "é" * 5_000, "hello" * 3_000, "<|endoftext|>", "=" * 4_097])
def test_long_pretokens(text):
    ids = CODEC.encode(text)
    assert [int(x) for x in ids.split()] == ORACLE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_cost_of_a_very_long_pretoken_is_near_linear():
    text = "abcdefghij" * 60_000
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_table(spark):
    rows = [(1, "The quick brown fox", "x"), (2, None, "x"), (3, "", None), (1, "The quick brown fox", "x"), (None, " \n ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, keep_ids=True).collect(), key=lambda r: (r.id is None, r.id))
    assert [r.n_tokens for r in out[:4]] == [4, 4, 0, 0]
    for r, text in zip(out, ["The quick brown fox"] * 2 + ["", "", " \n "]):
        ids = ORACLE.encode_ordinary(text)
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
