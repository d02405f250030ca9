import math
import re

import pytest
from pyspark.sql import functions as F

from docgrid.functions import places as p


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, places", [("23‐14‐30W1M", ["23-14-30-W1M"]), ("4-23-95-13W6M", ["4-23-95-13-W6M"]), ("4-23-95-13,W.6M", ["4-23-95-13-W6M"]), ("NE17-9-28WPM", ["NE-17-9-28-WPM"]), ("10-04-119-12W6M", ["4-119-12-W6M"]), ("no place", [])])
def test_dls(spark, text, places):
    assert [x.text for x in one(spark, p.dls, text)] == places


@pytest.mark.parametrize("text, places", [("a-1-A/94-H-8", ["a-1-A/94-H-8"]), ("a-1-A,94-H-8", ["a-1-A/94-H-8"]), ("e-1-A/94-H-8", [])])
def test_nts(spark, text, places):
    assert [x.text for x in one(spark, p.nts, text)] == places


@pytest.mark.parametrize("text, places", [("MLV47+11.40", ["MLV 47 + 11.40"]), ("MLV1216+10.3km", ["MLV 1216 + 10.3km"]), ("MLV1217", ["MLV 1217"])])
def test_mlv(spark, text, places):
    assert one(spark, p.mlv, text) == places


@pytest.mark.parametrize("text, places", [("50.1 N; 102.3002 W", [(50.1, 102.3002)]), ("5.1.2  Waterbody", []), ("Lat: 49.738174 Long: -94.663485", [(49.738174, 94.663485)]), ("50.1 N only", []), ("53°55'30\"N 120°30'0\"W", [(53.925, 120.5)])])
def test_lat_longs(spark, text, places):
    got = [(round(x.n, 6), round(x.w, 6)) for x in one(spark, p.lat_longs, text)]
    assert got == places


@pytest.mark.parametrize("value, most, expected", [(123.0, 5.0, 3.0), (-11.0, 1.0, -1.0), (49.5, 90.0, 49.5), (153.25, 90.0, 53.25), (0.0, 5.0, None)])
def test_cut_digits(spark, value, most, expected):
    assert spark.range(1).select(p.cut_digits(F.lit(value), most)).first()[0] == expected


@pytest.mark.parametrize("line, kind, ident", [("table 2.2", "table", "2.2"), ("Table 1-1", "table", "1-1"), ("Table B3", "table", "B3"), ("table A:title", "table", "A"), ("Figure 7 x", "figure", "7"), ("table AB", None, None), ("tables", None, None), ("table of contents", None, None)])
def test_heading(spark, line, kind, ident):
    got = one(spark, p.heading, line)
    assert (got and got.kind, got and got.id) == (kind, ident)


def test_survey_place_on_the_map(spark):
    at = lambda strict, *a: spark.range(1).select(p.dls_to_lat_long(*[F.lit(x) for x in a], strict=strict)).first()[0]
    got = at(False, None, 1, 1, 1, "4")
    assert math.isclose(got.n, 49 + math.degrees(0.5 / 3958.8)) and math.isclose(got.w, 110 + math.degrees(0.5 / (3958.8 * math.cos(math.radians(got.n)))))
    assert at(True, "NW", 7, 1, 1, "P").w > at(True, "NE", 7, 1, 1, "P").w
    box = F.struct(F.lit(56.0).alias("lat1"), F.lit(120.0).alias("lon1"), F.lit(56.25).alias("lat2"), F.lit(120.5).alias("lon2"))
    place = F.struct(F.lit("a").alias("quarter"), F.lit(1).alias("unit"), F.lit("A").alias("block"))
    got = spark.range(1).select(p.nts_to_lat_long(place, box)).first()[0]
    assert math.isclose(got.n, 56 + 0.5 / 120) and math.isclose(got.w, 120 + 0.25 / 160)


def plain_places(text, meridian):
    """Match after match with ``re``, as a reader would."""
    raw = re.sub(r"\s+", "", text or "")
    out, skip, check = [], False, False
    for kind, shown, pattern in p.RECORD_FORMS:
        pattern = re.compile(re.sub(r"\\k<(\w+)>", r"(?P=\1)", re.sub(r"\(\?<(\w)", r"(?P<\1", pattern)))
        source = raw.replace("1/4Sec", "-") if kind == "DLS" else raw
        if kind == "NTS1_3" and re.search(p.RECORD_FORMS[0][2], raw):
            continue

        def form(m):
            if kind == "DLS":
                return f"{m[1] or ''}-{int(m[2])}-{int(m[4])}-{int(m[5])}-W{m[7] or (meridian or '')[1:2] or '?'}M"
            g = {"NTS": (1, 3, 5, 7, 9, 11), "NTS1_2": (1, 2, 3, 5, 6, 7), "NTS1_3": (0, 1, 3, 5, 7, 9), "NTS2": (0, 6, 7, 1, 2, 4), "NTS3": (1, 3, 5, 7, 8, 9)}[kind]
            v = ["NA" if i == 0 else str(int(m[i])) if m[i].isdigit() else m[i] for i in g]
            return f"{v[0]}-{v[1]}-{v[2]}/{v[3]}-{v[4]}-{v[5]}"

        for no, m in enumerate(pattern.finditer(source), 1):
            if skip:
                skip = False
                continue
            if kind == "DLS" and not m[1] and not m[7]:
                continue
            near, end = source[m.end() - 1 : m.end() + 5], None
            check = check or kind == "DLS" and len(m[1] or "") != 2
            if ("to" in near or ":" in near) and (then := pattern.search(source[m.end() - 1 :])):
                end, skip = form(then), True
                check = check or kind == "DLS" and len(then[1] or "") != 2
            out.append((no, shown, form(m), end, check))
    return out


def test_record_places(spark):
    import random

    rng = random.Random(6)
    samples = [
        "SW 1/4 Sec 14-78-23 W6M", "NW-8-30-4-W4 to NE-9-30-4-W4", "B-027-J/094-I-11", "94I-14-E11", "a‑90‑I/94O11", "a1A/94H8", "B 025 K/094 I 11", "41-H/94-I-9", "b-1-C/94-H-2 : c-2-D/94-H-3", "41-H/94-I-9 to 42-H/94-I-10",
        "017-838-967", "12-5-30-4 W4: 3-6-30-4", "5-30-4-W5M", "P 42+134) NW-8-30-4-W4<s>2</s>ite #42 on Figure 2 014-925-681 (SW 1/4 Sec 14-78-23 W6M)", "a-1-B/2-C-3 to", "94I-14-E11:NE-5-30-4-W5", "nothing here", "", "1-1-1", "to:to",
    ]
    texts = samples + ["".join(rng.choice([*samples[:12], " to ", ":", " ", "x", "; "]) for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    rows = [(i, t, rng.choice(["W5M", None, "", "W"])) for i, t in enumerate(texts)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "i int, t string, m string")
    got = {r.i: ([tuple(x) for x in r.x], r.u) for r in df.select("i", p.extract_places(F.col("t"), F.col("m")).alias("x"), p.unknown_place(F.col("t")).alias("u")).collect()}
    for i, t, m in rows:
        assert got[i][0] == plain_places(t, m), (t, m)
    assert got[5][0] == [(1, "NTS", "a-1-A/94-H-8", None, False)]
    assert [r[0] for r in rows if got[r[0]][1]][:2] == [16, 19]


def test_contents_pages(spark):
    pages = {0: ["cover", "12"], 1: ["x", "List of Figures"], 2: [f"soils {i}" for i in range(11)], 3: [f"soils {i}" for i in range(10)], 4: ["a ...."], 6: ["b ......"]}
    df = spark.createDataFrame([("d", p_, i, t) for p_, ts in pages.items() for i, t in enumerate(ts)] + [("e", 0, 0, "soils 1"), ("e", 1, 0, None)], "doc_id string, page int, line int, text string")
    assert sorted(tuple(r) for r in p.contents_pages(df, "doc_id", "page", "text").collect()) == [("d", 1), ("d", 2)]


def test_captions(spark):
    lines = [(1, 0, "A Table 4\nof soils"), (1, 1, "Figure ... 2"), (2, 0, "to Photos\nfrom"), (2, 1, "Table of Contents"), (2, 2, "a table"), (2, 3, None)]
    df = spark.createDataFrame([("d", *x) for x in lines], "doc string, page int, line int, text string")
    assert [(r.page, r.line, r.following) for r in p.captions(df, "doc", "page", "line", "text").collect()] == [(1, 0, "Figure ... 2"), (2, 0, "Table of Contents")]


def test_outline(spark):
    nodes = [("d", 1, None, 2, "two", 9), ("d", 2, None, 1, "one", 3), ("d", 3, 2, 10, "late", 5), ("d", 4, 2, 2, "early", 4), ("d", 5, 4, 1, "deep", 4), ("d", 6, 99, 1, "lost", 1), ("e", 1, None, 1, "own", 1)]
    df = spark.createDataFrame(nodes, "doc_id string, node int, parent int, position int, title string, page int")
    got = [tuple(r) for r in p.outline_rows(df).orderBy("doc_id", "place").collect()]
    assert got == [("d", "one", 3, 0, 1), ("d", "early", 4, 1, 2), ("d", "deep", 4, 2, 3), ("d", "late", 5, 1, 4), ("d", "two", 9, 0, 5), ("e", "own", 1, 0, 1)]


def test_places_of_a_record_are_searched_once(spark):
    """Each form's matches and the text behind them are one search each, however often an entry names them."""
    df = spark.createDataFrame([("SW 1/4 Sec 1-2-3-W4 to NE-5-6-7-W4", "W5M")], "t string, m string").select(p.extract_places(F.col("t"), F.col("m")).alias("x"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2 * len(p.RECORD_FORMS)
    assert [(x.start, x.end, x.check) for x in df.first().x] == [("SW-1-2-3-W4M", "NE-5-6-7-W4M", False)]
