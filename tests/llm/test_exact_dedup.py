from pyspark.sql import functions as F

from docgrid.llm.exact_dedup import exact_dedup, exact_groups

ROWS = [(5, "a  b", "h"), (3, "a\tb", "h"), (7, None, "h"), (2, "", None), (9, " ", "x"), (8, "\n\n", "x"), (3, "a b", "again"), (None, "a b", "x"), (None, "only", "x"), (None, "only", "x"), (11, "z" * 200_000, "x"), (12, "a\u00a0b", "x")]
SCHEMA = "doc_id long, text string, hash string"


def expected(rows):
    import re

    groups = {}
    for i, text, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids)) for i in ids]
    return sorted(out, key=str)


def test_groups_and_collisions(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = lambda **k: sorted([(r.id, r.keep_id, r.group_size) for r in exact_groups(docs, **k).collect()], key=str)
    assert got() == expected(ROWS)
    # a hash under which texts collide: the comparison of bytes tells them apart
    assert got(hashed=lambda c: F.substring(F.md5(c), 1, 2)) == expected(ROWS)
    assert got(hashed=lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 0)) == expected(ROWS)


def test_kept_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [11, 12, 2, 3, 8, None]
    assert exact_dedup(docs.limit(0)).count() == 0
