import numpy as np
import pytest

from docgrid.llm.shard import find_row, permute, shard_rows


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 100, 1000, 4097])
def test_permutes_and_inverts(n):
    x = np.arange(n, dtype=np.uint64)
    y = permute(x, n, 3)
    assert sorted(y.tolist()) == x.tolist()
    assert permute(y, n, 3, back=True).tolist() == x.tolist()
    if n >= 100:
        assert (permute(x, n, 4) != y).any()


def test_table(spark):
    rows = [(i % 90 if i % 7 else None, i % 5) for i in range(103)]
    docs = spark.createDataFrame(rows, "doc_id long, size int")
    out = shard_rows(docs.repartition(3), ["doc_id", "size"], 16, key=9).collect()
    again = shard_rows(docs.repartition(5, "size"), ["doc_id", "size"], 16, key=9).collect()
    key = lambda r: (str(r.doc_id), r.size, r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert sorted(r.row_no for r in out) == list(range(103))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert find_row(r.shard, r.slot, 103, 16, 9) == r.row_no
    assert {len(v) for v in by.values()} <= {6, 7} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shard_rows(docs.limit(0), ["doc_id"], 16).count() == 0


def test_names_of_the_caller_stay_and_repeated_rows_spread(spark):
    rows = [(1, "mine", None)] * 400 + [(i, "x", "long " * 3000 if i == 5 else None) for i in range(60)] + [(None, None, None)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, slot string, __b string")
    out = shard_rows(docs.repartition(5), ["doc_id"], 16)
    assert out.columns == ["doc_id", "slot", "__b", "row_no", "shard", "slot_"]
    got = out.collect()
    assert sorted(r.row_no for r in got) == list(range(467)) and sum(r.slot == "mine" for r in got) == 400
    assert sorted((r.shard, r.slot_) for r in got) == sorted((p % 16, p // 16) for p in range(467))
    again = shard_rows(docs.repartition(2), ["doc_id"], 16).collect()
    assert sorted((str(r.doc_id), r.row_no) for r in got) == sorted((str(r.doc_id), r.row_no) for r in again)


def test_query(spark):
    """Every column of the query against the rows themselves."""
    import zlib

    from docgrid.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = queries.op6_shard(spark, "/root/testdata/sf0.001")
    assert [f"{f.name}:{f.dataType.simpleString()}" for f in out.schema] == ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"]
    rows, by = out.collect(), {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode()), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    assert {r.doc_id for r in rows} == {*docs} and len(rows) == len(docs) and {*by} == {*range(16)}
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_query_with_nulls_and_copies(spark, tmp_path):
    from docgrid.llm import queries

    rows = [(1, None)] * 3 + [(i, "same") for i in range(40)] + [(None, None), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_shard(spark, str(tmp_path)).collect()
    assert len(got) == 45 and sorted((r.shard, r.slot) for r in got) == sorted((p % 16, p // 16) for p in range(45)) and sum(r.size == 1 for r in got) == 4
