"""Grid functions against a plain Python model of what they mean."""

import random

import pytest
from pyspark.sql import functions as F

from docgrid.functions import grid as g

GRIDS = [
    [["A", "B", "C"], ["1", "x", ""], ["2", "", "y"]],
    [["A", "", "C"], ["egal Land Description", "x", "z"], ["  n \t", None, ""]],
    [["Top", "", "Other", ""], ["a", "b", "Other", "d"], ["1", "2", "3", "4"]],
    [["H1", "H2", "H3"], ["Soils", "", " "], ["1", "a", "b"], ["2", "c", "d"], ["Water", "", ""], ["3", "e", "f"]],
    [["", "x"], [" ", "y"], ["note", ""]],
    [["Legal (W5M)", "w6 and w4m", "z"]],
    [["a(cid:12)", "", "b"], ["", " ", ""], ["1", "", "<s>1,2</s>q"]],
]


def content(c):
    return bool(c and c.strip())


def fill_nulls(t):
    return [["" if c is None else c.strip() for c in r] for r in t]


def merge_headers(t):
    last, out = t[0][0], []
    for a, b in zip(t[0], t[1]):
        last = a if content(a) else last
        out.append(b if last == b else last + " " + b)
    return [out, *t[2:]]


def added(t):
    return [r + (["VEC", "GIS", "Topic"] if i == 0 else ["", "", ""]) for i, r in enumerate(t)]


def to_column(t, n):
    out, label = [], None
    for i, r in enumerate(t):
        if i and not any(map(content, r[1:])):
            label = r[0]
        elif label is None:
            out.append(r)
        else:
            out.append(r[:-n] + [label] + r[len(r) - n + 1 :])
    return out


def notes(t):
    t = t[:-1]
    return [r[1:] for r in t] if all(not content(r[0]) for r in t) else t


def capture(t):
    t = [[__import__("re").sub(r"\(cid:\d+\)", " ", c or "") for c in r] for r in t]
    t = [r for r in t if any(map(content, r))]
    keep = [j for j in range(len(t[0])) if any(content(r[j]) for r in t)] if t else []
    return [[r[j] for j in keep] for r in t]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(GRIDS)], f"id int, t {g.GRID}")


def run(frame, column):
    return [r[0] for r in frame.select("id", column.alias("x")).orderBy("id").select("x").collect()]


@pytest.mark.parametrize(
    "column, model",
    [
        (g.fill_nulls, fill_nulls),
        (g.drop_first_row, lambda t: t[1:]),
        (g.drop_last_row, lambda t: t[:-1]),
        (g.drop_first_column, lambda t: [r[1:] for r in t]),
        (g.drop_last_column, lambda t: [r[:-1] for r in t]),
        (g.drop_notes, notes),
        (g.repair_headings, lambda t: [[g.CUT_HEADINGS.get(c, c) for c in r] for r in t]),
        (g.add_label_columns, added),
        (g.clean_capture, capture),
        (lambda c: g.sections_to_column(g.add_label_columns(c), "VEC"), lambda t: to_column(added(t), 3)),
        (lambda c: g.sections_to_column(c, "Topic"), lambda t: to_column(t, 1)),
        (lambda c: g.merge_header_rows(g.fill_nulls(c)), lambda t: merge_headers(fill_nulls(t)) if len(t) > 1 else fill_nulls(t)),
        (g.blank_cells, lambda t: [sum(not __import__("re").search("[a-zA-Z0-9]", r[j] or "") for r in t) for j in range(len(t[0]))]),
        (lambda c: g.drop_named_column(c, "C"), lambda t: [[c for j, c in enumerate(r) if t[0][j] != "C"] for r in t]),
        (lambda c: g.sections(c), lambda t: [(r[0], i) for i, r in enumerate(t) if i and not any(map(content, r[1:]))]),
    ],
)
def test_against_model(frame, column, model):
    got = run(frame, column(F.col("t")))
    assert [[tuple(x) if hasattr(x, "asDict") else x for x in t] for t in got] == [model(t) for t in GRIDS]


def test_first_row_to_column(frame):
    t = added(GRIDS[3])
    got = run(frame.where("id = 3"), g.first_row_to_column(g.add_label_columns(F.col("t"))))[0]
    want = added([r[:-3] for r in t[1:]])
    assert got == [want[0], *[r[:-1] + ["H1"] for r in want[1:]]]


def test_meridian_and_small_ones(frame):
    assert run(frame, g.meridian(F.col("t")))[5] == "W6"
    assert run(frame.where("id = 6"), g.unstrike(F.col("t")[2][2]))[0] == "1,2q"
    assert run(frame.where("id = 0"), g.annotate(F.col("t"), ["id"], [F.lit(7)]))[0][:2] == [["id", "A", "B", "C"], ["7", "1", "x", ""]]
    assert run(frame.where("id = 0"), g.equal(F.col("t"), F.col("t")))[0] and not run(frame, g.equal(F.lit(None).cast(g.GRID), F.lit(None).cast(g.GRID)))[0]
    assert run(frame.where("id = 0"), g.row_class(F.col("t"), F.lit(False), F.lit(2)))[0] == ["dropped", "merged", "kept"]
    assert run(frame.where("id = 0"), g.odd_rows(F.col("t"), F.lit(2)))[0] == [0, 1, 2]


def stitched(parts):
    done = None
    for _, t, no_header, status in sorted(parts, key=lambda p: p[0]):
        if done is None:
            done = [list(r) for r in t]
            continue
        body = [list(r) for r in (t if no_header else t[1:])]
        if status == 2 and body and done:
            done[-1] = [a if b == "" else a.strip() + " " + b.strip() for a, b in zip(done[-1], body[0])]
            body = body[1:]
        done += body
    return done


def test_stitch_and_combine(spark):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        parts = [(lv, [[f"{lv}{r}{c} " if rng.random() < 0.7 else "" for c in range(3)] for r in range(rng.randint(1, 4))], rng.random() < 0.3, rng.randint(0, 2)) for lv in range(1, rng.randint(2, 5))]
        rng.shuffle(parts)
        rows.append((i, parts))
    df = spark.createDataFrame(rows, f"id int, p array<struct<level:int,grid:{g.GRID},no_header:boolean,append_status:int>>")
    got = run(df, g.stitch(F.col("p")))
    assert got == [stitched(p) for _, p in rows]
    both = run(df, g.combine(F.transform("p", lambda x: F.struct(x["level"].alias("level"), x["grid"].alias("grid")))))
    assert both == [sum([t if k == 0 else t[1:] for k, (_, t, _, _) in enumerate(sorted(p, key=lambda x: x[0]))], []) for _, p in rows]


def test_fill_down_is_idempotent(spark):
    t = [["a", "VEC", "GIS", "Topic"], ["1", "", "x", ""], ["2", "v", "", ""], ["3", "", "", "t"], ["4", "", "y", ""]]
    df = spark.createDataFrame([(0, t)], f"id int, t {g.GRID}")
    once = run(df, g.fill_down(F.col("t")))[0]
    assert once == [t[0], ["1", "", "x", ""], ["2", "v", "x", ""], ["3", "v", "x", "t"], ["4", "v", "y", "t"]]
    assert run(spark.createDataFrame([(0, once)], f"id int, t {g.GRID}"), g.fill_down(F.col("t")))[0] == once


def test_pipeline_order(spark):
    base = [["egal Land Description", "B", "C"], ["Soils", "", ""], ["1", None, "b"], ["note", "n", ""]]
    rows = [(0, base, [6, 5], [6, 5]), (1, base, [], [5]), (2, base, [13, 5], [13]), (3, base, [12], [12]), (4, base, [], []), (5, base, [7, 8, 9, 10], [])]
    df = spark.createDataFrame(rows, f"id int, t {g.GRID}, tags array<int>, chain array<int>")
    manual = F.array(F.array(F.lit("manual")))
    got = run(df, g.process(F.col("t"), F.col("tags"), F.col("chain"), manual))
    fixed = [[g.CUT_HEADINGS.get(c, c) for c in r] for r in fill_nulls(base)]
    assert got[0] == to_column(added(notes(fixed)), 3)
    assert got[1] == added(fixed) and got[2] == [["manual"]] and got[4] == fixed
    assert got[3] == [added([r[:-3] for r in added(fixed)[1:]])[0], *[r[:-1] + ["Legal Land Description"] for r in added([r[:-3] for r in added(fixed)[1:]])[1:]]]
    assert got[5] == [r[1:-1] for r in fixed[1:-1]]


def test_named_column_is_looked_for_once(spark):
    """A grid that is dropped a column is made once, not again for every cell."""
    from pyspark.sql import functions as F

    from docgrid.functions import grid as g

    df = spark.createDataFrame([([["a", "b"], ["1", None]],), (None,)], "g array<array<string>>").select(g.drop_named_column(g.annotate(F.col("g"), ["id"], [F.lit(7)]), "a").alias("x"))
    assert df._jdf.queryExecution().analyzed().toString().count("array_position(") == 1
    assert [r.x for r in df.collect()] == [[["id", "b"], ["7", None]], None]
