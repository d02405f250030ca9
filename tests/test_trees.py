import pytest

from docgrid.functions.places import outline_rows
from docgrid.operators.trees import down

#: Rows of one query that Spark lets a recursive query make.
MOST = "spark.sql.cteRecursionRowLimit"


def test_levels_of_deep_chains_circles_and_orphans(spark):
    deep = [(i, i - 1 if i else None) for i in range(150)]
    rows = deep + [(1000, 1001), (1001, 1000), (1002, 1000), (2000, 3000)]
    got = {r.node: r.up for r in down(spark.createDataFrame(rows, "node int, parent int"), ["node"], "parent").collect()}
    assert got == {i: i for i in range(150)}


def test_empty_forest(spark):
    assert down(spark.createDataFrame([], "node int, parent int"), ["node"], "parent").count() == 0


@pytest.mark.parametrize("query", ["chain_levels", "outline_rows"])
def test_more_rows_than_a_recursive_query_may_make(spark, query):
    import __spark_entry__ as entry

    old = spark.conf.get(MOST)
    spark.conf.set(MOST, "100")
    try:
        assert entry.queries()[query](spark, "/root/testdata/sf0.001").count() > 1000
    finally:
        spark.conf.set(MOST, old)


def test_outline_in_reading_order(spark):
    nodes = spark.createDataFrame([("d", "b", None, 2, "B", 5), ("d", "a", None, 1, "A", 1), ("d", "a2", "a", 2, "A2", 3), ("d", "a1", "a", 1, "A1", 2), ("d", "x", "a2", 1, "X", 4), ("e", "a1", None, 1, "E", 1)], "doc_id string, node string, parent string, position int, title string, page int")
    got = [(r.doc_id, r.title, r.level, r.place) for r in outline_rows(nodes).orderBy("doc_id", "place").collect()]
    assert got == [("d", "A", 0, 1), ("d", "A1", 1, 2), ("d", "A2", 1, 3), ("d", "X", 2, 4), ("d", "B", 0, 5), ("e", "E", 0, 1)]
