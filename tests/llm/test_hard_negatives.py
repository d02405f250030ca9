import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.llm import hard_negatives, queries
from docgrid.llm.sql import SQL

SF = "/root/testdata/sf0.001"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100):
    """By loops over rows (id, label, vector)."""
    dim = max((len(v) for _, _, v in rows if v), default=0)
    ok = [(i, d, np.array([*v, *[0] * (dim - len(v))], float)) for i, d, v in rows if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (i, d, v) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = [(int(v @ w), j, e) for m, (j, e, w) in enumerate(ok) if m != n]
        mine = sorted((x for x in scored if x[2] == d), key=lambda x: (-x[0], last(x[1])))[:5]
        for s, j, _ in mine:
            others = sorted((x for x in scored if x[2] != d and 80 * s <= 100 * x[0] <= 100 * s), key=lambda x: (-x[0], last(x[1])))[:5]
            out += [(i, j, k + 1, o, s, t) for k, (t, o, _) in enumerate(others)]
    return sorted(out, key=str)


def run(spark, rows, every=100):
    df = spark.createDataFrame([(i, d, v, "x") for i, d, v in rows], "id long, label int, vector array<double>, score string").repartition(3)
    return sorted((tuple(r[c] for c in NAMES) for r in hard_negatives.mine(df.withColumn("anchor", F.col("id") % every == 0)).collect()), key=str)


@pytest.mark.parametrize("spread", [3, 40])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-60, 60, (12, 8))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 12] + rng.integers(-spread, spread + 1, 8)).astype(float).tolist()) for i in range(1500)]
    assert run(spark, rows, 50) == brute(rows, 50) != []


def test_ties_copies_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(200)]
    rows += [(1000 + i, i % 2, [2.0, 2.0, 1.0, 0.0]) for i in range(700)]  # a common vector
    rows += [(None, 1, [2.0, 2.0, 1.0, 1.0]), (None, 0, [1.0, 1.0, 1.0, 1.0]), (2000, None, [1.0] * 4), (2001, 1, None), (2002, 1, [1.0, None, 1.0, 1.0]), (2100, 1, [1.0, math.nan, 1.0, 1.0]), (2200, 0, [1.0, math.inf, 1.0, 1.0])]
    rows += [(100, 1, rows[100][2]), (2300, 2, [1.0, 2.0]), (2400, 1, []), (100, 1, rows[100][2])]
    got = run(spark, rows)
    assert [(a, p, k, s, t) for a, p, k, _, s, t in got] == [(a, p, k, s, t) for a, p, k, _, s, t in brute(rows)]
    assert got == brute(rows)


def test_cells_pass_by_the_driver(spark, monkeypatch):
    """What queries ask of the index is joined with it by a merge; neither is broadcast."""
    plans, real = [], hard_negatives.cut

    def cut(df, name="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(hard_negatives, "cut", cut)
    run(spark, [(i, i % 3, [float(i % 7), float(i % 11)]) for i in range(300)])
    joins = [line for p in plans for line in p.splitlines() if "Join [pivot" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0, 2.0])]) == []
    rows = [(0, 1, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 0, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 1, 2, 0, 0)]


def test_index_holds_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, 0, rng.normal(size=3).tolist(), False) for i in range(500)] + [(500 + i, 0, [9.0, 9.0, 9.0], False) for i in range(200)], "id long, label int, vector array<double>, anchor boolean")
    index = hard_negatives.build_index(df)
    blocks = index.blocks.collect()
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(700)) and max(b["n"] for b in blocks) <= 32
    assert len({b["first"] + i for b in blocks for i in range(b["n"])}) == 700
    assert len({b["ring"] for b in blocks}) > 1


def test_little_is_read_where_vectors_cluster(spark):
    """Queries in tight clusters stop at the first radii: few of the pairs of a query's group and a block meet."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 6)) * 500
    rows = [(i, i % 2, np.round(centres[i % 16] + rng.normal(size=6)).tolist(), i % 100 == 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>, anchor boolean")
    index = hard_negatives.build_index(df)
    anchors = hard_negatives.anchors_of(index).withColumn("lows", F.array(F.lit(float("-inf")))).withColumn("highs", F.array(F.lit(float("inf"))))
    found = hard_negatives.search(index, anchors, 5, True)
    assert found.count() == 60 * 5


def test_query_and_sql(spark):
    path = f"{SF}/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(SQL["op12_hard_negatives"])
    got = queries.op12_hard_negatives(spark, SF)
    assert got.columns == want.columns == NAMES
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []
    rows = []
    for r in spark.read.parquet(path).collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [math.floor(256 * float(x)) for x in r.embedding]))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
