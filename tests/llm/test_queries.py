"""Each registered query over a small folder of tables: names, types, folds, nulls, and every column against a plain model."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

from docgrid.llm import bpe, queries
from docgrid.llm.sql import SQL
from tests.llm.test_ngram_join import brute as near_copies
from tests.llm.test_pii import brute as personal_data
from tests.llm.test_suffix_dedup import brute as repeated_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with rows that are null, empty, repeated or long, and columns that clash."""
    where = str(tmp_path_factory.mktemp("tables"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    docs += [(9001, None), (9002, ""), (9003, " \n"), (9004, docs[0][1]), (9005, docs[0][1]), (9006, "ab " * 3000), (9007, f"x{passage}y"), (9008, f"{passage}é"), (None, "mail a.b@c.de and +1 (017) 555-7713")]
    spark.createDataFrame([(*d, "row", 1) for d in docs], "doc_id long, text string, row string, id int").repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()] + [(9001, 0, 0), (9002, None, None), (None, 1, 0), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(None, "no id"), (800, None), (801, " ")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.read.parquet(f"{SF}/pages.parquet").write.parquet(f"{where}/pages.parquet")
    return where, docs, {d: q for d, q, _ in labels}, items


def run(spark, name, folder):
    df = queries.queries()[name](spark, folder[0])
    return [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema], sorted((tuple(r) for r in df.collect()), key=str)


def fold(doc_id, m):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()) == list(range(1, 14))


def test_op1(spark, folder):
    columns, rows = run(spark, "op1_pii", folder)
    assert columns[:7] == ["doc_id:bigint", "n_email:bigint", "n_ip:bigint", "n_card:bigint", "n_phone:bigint", "base_sha256:string", "spans:string"]
    want = []
    for d, t in folder[1]:
        found = personal_data(t or "")
        base = ",".join(f"{k}:{a}:{z}" for k in ("email", "ip", "card", "phone") for a, z in found[k])
        want.append((d, *(len(found[k]) for k in ("email", "ip", "card", "phone")), hashlib.sha256(base.encode()).hexdigest()))
    assert [r[:6] for r in rows] == sorted(want, key=str)


def test_op2_finds_whole_items(spark, folder):
    columns, rows = run(spark, "op2_decontam", folder)
    assert columns[0] == "doc_id:bigint" and len(rows) == len(folder[1])
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).strip(" ")
    got = {r[0]: set(r[3] or ()) for r in rows}
    for d, t in folder[1]:
        assert {i for i, x in folder[3] if i is not None and flat(x) and flat(x) in flat(t)} <= got[d]
        assert (d, bool(got[d])) in {r[:2] for r in rows}


def test_op3_and_op7_equal_their_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{folder[0]}/{t}.parquet/*.parquet'")
    for name in ("op3_exact_dedup", "op7_url_filter"):
        want = con.sql(SQL[name])
        columns, rows = run(spark, name, folder)
        assert [c.split(":")[0] for c in columns] == want.columns
        if name == "op7_url_filter":
            assert rows == sorted(want.fetchall(), key=str)
        else:  # SQL knows no row without an id that stays
            assert [r for r in rows if r[0] is not None] == sorted((r for r in want.fetchall() if r[0] is not None), key=str)


def test_op4(spark, folder):
    columns, rows = run(spark, "op4_quality", folder)
    assert columns[:4] == ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"] and len(rows) == len(folder[1])
    right = []
    for d, held, score, predicted in (r[:4] for r in rows):
        assert 0 <= score <= 1 and predicted == int(score >= 0.5) and held == (None if d is None else fold(d, 3) == 1)
        if held and folder[2].get(d) is not None:
            right.append(predicted == folder[2][d])
    assert sum(right) / len(right) > 0.9


def test_op5(spark, folder):
    columns, rows = run(spark, "op5_ngram_join", folder)
    assert columns[:3] == ["doc_id:bigint", "n_shingles:bigint", "component_id:bigint"]
    assert [r[:3] for r in rows] == near_copies(folder[1], 4, 85)


def test_op8(spark, folder):
    columns, rows = run(spark, "op8_suffix_dedup", folder)
    assert columns[:5] == ["doc_id:bigint", "n_bytes:bigint", "n_removed:bigint", "n_spans:bigint", "kept_sha256:string"]
    assert [r[:5] for r in rows] == repeated_bytes(folder[1], 200)


def test_op9(spark, folder):
    columns, rows = run(spark, "op9_bpe", folder)
    assert columns[:4] == ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"]
    ranks = bpe.load_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(ids := codec.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in folder[1]]
    assert [r[:4] for r in rows] == sorted(want, key=str)


def test_op10(spark, folder):
    columns, rows = run(spark, "op10_lm", folder)
    assert columns[:7] == ["doc_id:bigint", "held_out:boolean", "n_tokens:bigint", "n_known:bigint", "train_tokens:bigint", "base_score:double", "score:double"]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(x for d, t in folder[1] if fold(d, 10) not in (0, None) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = sorted((r[:6] for r in rows), key=str)
    want = []
    for d, t in folder[1]:
        words = tokens(t)
        want.append((d, None if d is None else fold(d, 10) == 0, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    want.sort(key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(got, want)) and all(r[6] < 0 for r in rows)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_conversations"])
def test_sql_of_the_new_operators(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(SQL[name])
    columns, rows = run(spark, name, (SF,))
    assert [c.split(":")[0] for c in columns] == want.columns and rows == sorted(want.fetchall(), key=str)
