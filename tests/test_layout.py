"""Layout and company rules against plain models, page by page."""

import math
import random

import numpy as np
import pytest

from docgrid.operators import layout
from docgrid.operators.companies import writing_companies


def test_contents_rows_and_labels(spark):
    lines = ["Contents", "Table 1: A long table", "title................2", "1 Introduction ..... 3", "Table 2 Soils", "Figure A-1 Map of", "the site", "Table 3 Wells ..... 7", "Appendix", "Table 4 Last"]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(lines)] + [("d", 2, 0, "Table 1 Again.....12"), ("d", 2, 1, None), ("e", 1, 0, "nothing")], "doc_id string, page int, line int, text string")
    rows = layout.contents_rows(df)
    got = [r.text for r in rows.where("page = 1").orderBy("row").collect()]
    assert got == ["Table 1: A long table title................2", "1 Introduction ..... 3", "Table 2 Soils", "Figure A-1 Map of the site Table 3 Wells ..... 7", "Table 4 Last"]
    labels = {r.label: (r.title, r.shown_page) for r in layout.contents_labels(rows).collect()}
    assert labels["table1"] == ("Again", 12) and labels["table2"] == ("Soils", None) and labels["figurea-1"] == ("Map of the site Table 3 Wells", 7)


def test_captions_over_lines(spark):
    lines = [("text", 9.0), ("TABLE 7 SUMMARY OF WORKS", 12.0), ("2", 6.0), ("WATERBODIES", 12.0), ("body text", 10.0), ("WATERBODIES", 12.0), ("Figure 2", 12.0), ("Table 3", 12.0), ("more of it", 12.0)]
    df = spark.createDataFrame([(1, 1, i, t, h, [h] if i != 3 else [h, 1.0]) for i, (t, h) in enumerate(lines)], "doc_id int, page int, line int, text string, height double, fonts array<double>")
    got = [(r.line, r.text, r.lines) for r in layout.captions(df).orderBy("line").collect()]
    assert got == [(1, "TABLE 7 SUMMARY OF WORKS 2 WATERBODIES", 3), (6, "Figure 2", 1), (7, "Table 3 more of it", 2)]
    assert [r.text for r in layout.captions(df, "fonts").orderBy("line").collect()][0] == "TABLE 7 SUMMARY OF WORKS 2"


def is_table_caption(text):
    return text.lower().startswith(("table", "appendix"))


def model(images, labels, lines, contents):
    """Page after page, as one would by hand."""
    out, before = {}, {}
    for doc, page in sorted({(i["doc"], i["page"]) for i in images}):
        here = sorted((i for i in images if (i["doc"], i["page"]) == (doc, page)), key=lambda i: i["image"])
        names = sorted((x for x in labels if (x["doc"], x["page"]) == (doc, page)), key=lambda x: x["label"])
        writing = sorted((x for x in lines if (x["doc"], x["page"]) == (doc, page)), key=lambda x: x["line"])
        row = sorted([(x["cy"], 0, x["label"], x) for x in names] + [(i["y"] + i["h"] / 2, 1, i["image"], i) for i in here], key=lambda e: e[:3])
        side = 0 if not row or row[0][1] == row[-1][1] else (-1 if row[0][1] == 0 else 1)
        for i in here:
            text, way = None, None
            if side:
                near = row[next(k for k, e in enumerate(row) if e[1] == 1 and e[2] == i["image"]) + side]
                if near[1] == 0 and is_table_caption(near[3]["text"]) == i["table"]:
                    text, way = near[3]["text"], "layout"
            if text is None:
                some = names
                if i["table"]:
                    some = [x for x in names if not (i["x"] <= x["cx"] <= i["x"] + i["w"] and i["y"] <= x["cy"] <= i["y"] + i["h"])] or names
                some = [x for x in some if is_table_caption(x["text"]) == i["table"]]
                if some:
                    text, way = min(some, key=lambda x: math.hypot(i["x"] + i["w"] / 2 - x["cx"], i["y"] + i["h"] / 2 - x["cy"]))["text"], "nearest"
            if text is None and i["table"]:
                last = [t for t in before.get((doc, page - 1), []) if t[0]["table"]]
                if last and abs(last[-1][0]["w"] - i["w"]) < 5 and last[-1][1] is not None:
                    text, way = last[-1][1], "page before"
            if text is None and not i["table"] and writing and i["w"] * i["h"] / (600 * 800) >= 0.7:
                low = [x for x in writing if x["y"] <= 160] or writing
                for x in sorted(low, key=lambda x: (-x["font"], x["line"])):
                    k = writing.index(x)
                    parts = [x["text"]]
                    for z in writing[k + 1 :]:
                        if len(z["text"]) > 3 and z["height"] != x["height"]:
                            break
                        parts.append(z["text"])
                    text, way = " ".join(parts).strip(), "largest"
                    if sum("a" <= c <= "z" for c in text.lower()) >= 5:
                        break
            before.setdefault((doc, page), []).append((i, text))
            out[doc, page, i["image"]] = (text, way, contents.get((doc, text)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pictures_equal_the_model(spark, seed):
    rng = random.Random(seed)
    images, labels, lines = [], [], []
    texts = ["Table 1 soils", "Figure 2 map", "Table 3 wells", "Figure 4", "Appendix A list"]
    for doc in range(6):
        for page in range(1, 9):
            for n in range(rng.choice([0, 1, 1, 2, 3])):
                big = rng.random() < 0.3
                images.append({"doc": doc, "page": page, "image": n, "x": float(rng.randrange(0, 300)), "y": float(rng.randrange(0, 500)), "w": rng.choice([590.0, 100.0, 103.0, 106.0]) if not big else 590.0, "h": 790.0 if big else 60.0, "table": rng.random() < 0.6})
            for n in range(rng.choice([0, 0, 0, 1, 2])):
                labels.append({"doc": doc, "page": page, "label": n, "cx": float(rng.randrange(0, 600)), "cy": float(rng.randrange(0, 800)), "text": rng.choice(texts)})
            for n in range(rng.choice([0, 3, 8])):
                lines.append({"doc": doc, "page": page, "line": n, "text": rng.choice(["Overview of the site", "m2", "", "x 1", "LEGEND AND", "12345"]), "y": float(rng.choice([50, 100, 300])), "height": float(rng.choice([10, 12])), "font": float(rng.choice([10, 12, 20]))})
    contents = [(d, "table1", f"one of {d}") for d in range(3)] + [(1, "figure2", "two")]
    df = lambda rows, schema: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    from pyspark.sql import functions as F

    pictures = df(images, "doc_id int, page int, image int, x double, y double, w double, h double, is_table boolean").withColumns({"page_w": F.lit(600.0), "page_h": F.lit(800.0)})
    got = layout.tag_images(
        pictures, df(labels, "doc_id int, page int, label int, cx double, cy double, text string"), spark.createDataFrame(contents, "doc_id int, label string, title string"),
        df(lines, "doc_id int, page int, line int, text string, y double, height double, font double"),
    ).collect()
    titles = {(d, t): title for d, key, title in contents for t in texts if key == t.split()[0].lower() + t.split()[1]}
    want = model(images, labels, lines, titles)
    assert {(r.doc_id, r.page, r.image): (r.text, r.way, r.title) for r in got} == want and len(got) == len(want)


def merged(boxes):
    todo = [(x, y, x + w, y + h) for x, y, w, h in boxes]
    touch = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    left, parts = set(range(len(todo))), []
    while left:
        group, new = set(), {left.pop()}
        while new:
            group |= new
            new = {j for j in left if any(touch(todo[i], todo[j]) for i in new)}
            left -= new
        b = [todo[i] for i in group]
        parts.append((min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b)))
    outer = [a for a in parts if not any(b != a and b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3] for b in parts)]
    return sorted((a, b, c - a, d - b) for a, b, c, d in outer)


def test_boxes_equal_the_model(spark):
    rng = random.Random(3)
    images = {i: [(float(rng.randrange(0, 60)), float(rng.randrange(0, 60)), float(rng.randrange(0, 9)), float(rng.randrange(0, 30 if i % 2 else 9))) for _ in range(rng.randrange(1, 40))] for i in range(40)}
    df = spark.createDataFrame([(i, *b) for i, bs in images.items() for b in bs], "image_id int, x double, y double, w double, h double")
    got = {}
    for r in layout.merge_boxes(df).collect():
        got.setdefault(r.image_id, []).append((r.x, r.y, r.w, r.h))
    assert {i: sorted(b) for i, b in got.items()} == {i: merged(b) for i, b in images.items()}


@pytest.mark.parametrize("spread", [400_000.0, 50.0])
def test_a_picture_of_many_boxes(spread):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, spread, 30_000), rng.uniform(0, spread, 30_000)
    part = layout._components(x, y, x + rng.uniform(0, 20, len(x)), y + rng.uniform(0, 20, len(x)))
    assert len(np.unique(part)) == (1 if spread < 100 else len(np.unique(part))) and len(part) == len(x)


def test_whole_pictures_and_marks(spark):
    boxes = [("many", float(50 * i), 0.0, 40.0, 40.0) for i in range(10)] + [("few", 0.0, 0.0, 20.0, 90.0), ("few", 30.0, 0.0, 21.0, 21.0), ("few", 40.0, 10.0, 30.0, 30.0)]
    df = spark.createDataFrame(boxes, "image_id string, x double, y double, w double, h double")
    sizes = spark.createDataFrame([("many", 700, 500), ("few", 100, 100)], "image_id string, w int, h int")
    assert sorted(tuple(r) for r in layout.picture_parts(df, sizes).collect()) == [("few", 30.0, 0.0, 40.0, 40.0), ("many", 0.0, 0.0, 700.0, 500.0)]


def test_each_step_of_a_company(spark):
    pdfs = [(1, "A1", 10, "Own"), (2, "A2", 10, "Own"), (3, "A3", 11, "Own"), (4, "A4", 12, "Own"), (5, "A5", 13, "Own"), (6, "A6", 14, "Own"), (7, "PREFIX-1-x", 15, "Own"), (8, "A8", None, None), (9, "A9", 16, "Own")]
    pages = [
        (1, 0, "By GOLDER\n\nAssociates"), (2, 0, "Stantec & Co"), (3, 0, None), (3, 1, "table of  contents"), (3, 2, "stantec"), (4, 0, ""), (4, 1, "by Stantec; see"), (4, 2, "table, of contents Golder Associates"),
        (5, 0, "x"), (5, 1, ""), (5, 2, "golder-associates, Golder Associates"), (6, 0, "none"), (6, 1, "Stantec"), (6, 2, "no list"), (7, 0, "Stantec"), (9, 0, "Golder"), (9, 1, "table of contents"),
    ]
    names = spark.createDataFrame([("Golder Associates",), ("Stantec",), ("Stantec",), (None,), ("",)], "name string")
    out = writing_companies(
        spark.createDataFrame(pdfs, "pdf_id int, pdf_name string, filing_id int, company string"), spark.createDataFrame(pages, "pdf_id int, page int, text string"), names, {16: ["Triton", "SLR"]}, {"PREFIX-1": ["CCI"]}
    )
    assert {r.pdf_id: (r.step, r.companies) for r in out.collect()} == {
        1: ("page 1", ["Golder Associates", "Stantec"]), 2: ("page 1", ["Golder Associates", "Stantec"]), 3: ("own", ["In-house Consulting: Own"]), 4: ("page 2", ["Stantec"]), 5: ("page 3", ["Golder Associates"]),
        6: ("own", ["In-house Consulting: Own"]), 7: ("prefix", ["CCI"]), 8: ("own", ["In-house Consulting: "]), 9: ("filing", ["SLR", "Triton"]),
    }


def test_names_of_a_filing_join_last(spark):
    """A filing's names are as many as its documents have: nothing below the last join carries them for each document."""
    import __spark_entry__ as entry

    plan = entry.queries()["writing_companies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        plan = plan.children().apply(0)
    documents = plan.children().apply(0)
    assert "n2" in plan.children().apply(1).output().toString() and "n2" not in documents.output().toString()


def test_names_of_a_filing_become_text_once(spark):
    """They are joined to a text where a filing stands once, and captured tables are numbered once, not again for every mention of their pages."""
    import __spark_entry__ as entry

    df = entry.queries()["writing_companies"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        plan = plan.children().apply(0)
    assert "n2:string" in plan.children().apply(1).schema().simpleString()
    assert not [f for f in df.inputFiles() if "lineitem" in f]
