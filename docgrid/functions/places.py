
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.grid import let

EARTH_MILES = 3958.8
#: Fixed patterns of location forms; those with back-references in the JVM's dialect.
DEGREES = r"(\d{1,3}(?:\.\d+))\s*([NWSE](?=[^a-z0-9]|$))"
NAMED = r"(?i)(lat|long|latitude|longitude)[:\s]+(-?\d{1,3}(?:\.\d+))"
DMS = r"(\d{1,3}(?:\.\d+)?)[°](\d+(?:\.\d+)?)['’](\d+(?:\.\d+)?)['\"’”]+([NWSE])"
DLS = r"(?<lsd>(?:1[1-6]|0?[1-9])(?=[^a-zA-Z0-9])|(?:NW|NE|SW|SE))?[^a-zA-Z0-9]?(?<section>\d{1,3})(?<delim>[^a-zA-Z0-9])(?<township>\d{1,3})\k<delim>(?<range>\d{1,3})\s*[^a-zA-Z0-9]?W[^a-zA-Z0-9]?(?<meridian>[0-9P])M?"
NTS = r"([a-dA-D])(?<delim>[^a-zA-Z0-9])(\d{1,3})\k<delim>([a-lA-L])[^a-zA-Z0-9](\d{1,3})\k<delim>([a-pA-P])\k<delim>(1[1-6]|0?[1-9])"
#: Fixed forms of a record's places, in the order in which they are read: kind, shown format, pattern.
RECORD_FORMS = (
    ("NTS", "NTS", r"([a-dA-D])([^a-zA-Z0-9])(\d{1,3})([^a-zA-Z0-9])([a-lA-L])([^a-zA-Z0-9])(\d{1,3})([^a-zA-Z0-9])([a-pA-P])([^a-zA-Z0-9])(1[1-6]|0?[1-9])"),
    ("NTS1_2", "NTS", r"([a-dA-D])(\d{1,3})([a-lA-L])([^a-zA-Z0-9])(\d{1,3})([a-pA-P])(\d{1,3})"),
    ("NTS1_3", "NTS2", r"(\d{1,3})([^a-zA-Z0-9])([a-lA-L])([^a-zA-Z0-9])(\d{1,3})([^a-zA-Z0-9])([a-pA-P])([^a-zA-Z0-9])(\d{1,3})"),
    ("NTS2", "NTS2", r"(\d{1,3})([a-zA-Z])([^a-zA-Z0-9])(\d{1,3})([^a-zA-Z0-9])([a-zA-Z])(\d{1,3})"),
    ("NTS3", "NTS", r"([a-z])([^a-zA-Z0-9])(\d{1,3})([^a-zA-Z0-9])([A-Z])([^a-zA-Z0-9])(\d{1,3})([A-Z])(\d{1,3})"),
    ("DLS", "DLS", DLS.replace(r"W[^a-zA-Z0-9]?(?<meridian>[0-9P])M?", r"(W[^a-zA-Z0-9]?(?<meridian>[0-9P])M?|\s*)")),
)
#: How many groups a form has, and its text: group numbers (# as a whole number), = before plain characters.
RECORD_GROUPS = {"NTS": 11, "NTS1_2": 7, "NTS1_3": 9, "NTS2": 7, "NTS3": 9, "DLS": 7}
RECORD_TEXT = {
    "NTS": ("1", "=-", "#3", "=-", "5", "=/", "#7", "=-", "9", "=-", "#11"),
    "NTS1_2": ("1", "=-", "#2", "=-", "3", "=/", "#5", "=-", "6", "=-", "#7"),
    "NTS1_3": ("=NA-", "#1", "=-", "3", "=/", "#5", "=-", "7", "=-", "#9"),
    "NTS2": ("=NA-", "6", "=-", "#7", "=/", "#1", "=-", "2", "=-", "#4"),
    "NTS3": ("1", "=-", "#3", "=-", "5", "=/", "#7", "=-", "8", "=-", "#9"),
}
MLV = r"MLV\)?(\d+)(?:\+(\d+(?:\.\d+)?)(km|m)?)?"
HEADINGS = ("plate", "figure", "photo", "image", "table", "appendix")
LABEL = r"(?i)((" + "|".join(HEADINGS) + r"):?(?:(?:\s*((?:\d+(?:[.\-]?\d+)*)|(?:[a-z](?:[.\-]?\d+)+)))|(?:\s+([a-z])(?:$|[^a-z]))))"


def cut_digits(value: Column, most: float) -> Column:
    """Leading digits off until the amount is at most ``most``; null for nothing left."""
    whole = F.abs(value)
    out = F.when(whole <= most, whole)
    for power in (3, 2, 1):
        out = F.coalesce(out, F.when(whole % F.lit(float(10**power)) <= most, whole % F.lit(float(10**power))))
    return F.when(out != 0, out * F.signum(value))


def dms_degrees(degrees: Column, minutes: Column, seconds: Column) -> Column:
    """[F37]"""
    return degrees + minutes / 60 + seconds / 3600


def decimal_tags(text: Column) -> Column:
    """[L1] array<struct<value double, side string>> of '50.1 N' forms."""
    return F.transform(F.regexp_extract_all(text, F.lit(DEGREES), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"^([\d.]+)", 1).cast("double").alias("value"), F.right(m, F.lit(1)).alias("side")))


def named_tags(text: Column) -> Column:
    """[L2] 'Lat: -49.7' forms; the sign gives the side, 0 counts as south or west."""
    def tag(m: Column) -> Column:
        v = F.regexp_extract(m, r"(-?[\d.]+)$", 1).cast("double")
        lat = ~F.lower(m).startswith("long")
        return F.struct(F.abs(v).alias("value"), F.when(lat, F.when(v > 0, "N").otherwise("S")).otherwise(F.when(v > 0, "E").otherwise("W")).alias("side"))

    return F.transform(F.regexp_extract_all(text, F.lit(NAMED), F.lit(0)), tag)


def dms_tags(text: Column) -> Column:
    """[L3] Degrees, minutes and seconds, white space taken out before."""
    def tag(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, DMS, i)
        side = part(4)
        degrees = F.when(side.isin("N", "S"), cut_digits(part(1).cast("double"), 90.0)).otherwise(cut_digits(part(1).cast("double"), 180.0))
        return F.struct(dms_degrees(degrees, part(2).cast("double"), part(3).cast("double")).alias("value"), side.alias("side"))

    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(DMS), F.lit(0)), tag)


def lat_longs(text: Column) -> Column:
    """[L4, W12] array<struct<n double, w double>>: a north or south value with the east or west one after it.

    Without one of either kind the text has none.
    """
    tags = F.concat(decimal_tags(text), named_tags(text), dms_tags(text))
    north, west = (lambda t: t["side"].isin("N", "S")), (lambda t: t["side"].isin("W", "E"))
    start = F.struct(F.lit(None).cast("struct<value:double,side:string>").alias("open"), F.array().cast("array<struct<n:double,w:double>>").alias("done"))

    def step(s: Column, t: Column) -> Column:
        o = s["open"]
        fits = o.isNotNull() & west(t)
        n = cut_digits(F.when(o["side"] == "N", o["value"]).otherwise(-o["value"]), 90.0)
        w = cut_digits(F.when(t["side"] == "W", t["value"]).otherwise(-t["value"]), 180.0)
        pair = F.when(fits, F.array(F.struct(n.alias("n"), w.alias("w")))).otherwise(F.array().cast("array<struct<n:double,w:double>>"))
        return F.struct(F.when(north(t), t).alias("open"), F.concat(s["done"], pair).alias("done"))

    both = F.exists(tags, north) & F.exists(tags, west)
    return F.when(both, F.aggregate(tags, start, step, lambda s: s["done"])).otherwise(F.array().cast("array<struct<n:double,w:double>>"))


def dls(text: Column) -> Column:
    """[L5] array<struct<lsd, section, township, range, meridian, text>> of Dominion Land Survey places; white space taken out before."""
    def tag(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, DLS, i)
        lsd = F.nullif(F.regexp_replace(part(1), r"^0", ""), F.lit(""))
        number = lambda i: part(i).cast("int").cast("string")
        body = F.concat_ws("-", lsd, number(2), number(4), number(5), F.concat(F.lit("W"), part(6), F.lit("M")))
        return F.struct(lsd.alias("lsd"), part(2).cast("int").alias("section"), part(4).cast("int").alias("township"), part(5).cast("int").alias("range"), part(6).alias("meridian"), body.alias("text"))

    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(DLS), F.lit(0)), tag)


def nts(line: Column) -> Column:
    """[L6] array<struct<quarter, unit, block, series, area, sheet, text>> of National Topographic System places."""
    def tag(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, NTS, i)
        q, b, a = F.lower(part(1)), F.upper(part(4)), F.upper(part(6))
        unit, series, sheet = (part(i).cast("int") for i in (3, 5, 7))
        return F.struct(q.alias("quarter"), unit.alias("unit"), b.alias("block"), series.alias("series"), a.alias("area"), sheet.alias("sheet"), F.format_string("%s-%d-%s/%d-%s-%d", q, unit, b, series, a, sheet).alias("text"))

    return F.transform(F.regexp_extract_all(F.regexp_replace(line, r"\s+", ""), F.lit(NTS), F.lit(0)), tag)


def mlv(text: Column) -> Column:
    """[L7] Mainline valves as 'MLV 47 + 11.40km'."""
    def tag(m: Column) -> Column:
        valve, offset, unit = (F.regexp_extract(m, MLV, i) for i in (1, 2, 3))
        return F.when(offset == "", F.concat(F.lit("MLV "), valve)).otherwise(F.concat(F.lit("MLV "), valve, F.lit(" + "), offset, unit))

    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(MLV), F.lit(0)), tag)


def _step(i: Column, n: int, strict: bool) -> tuple[Column, Column]:
    """Row and column of cell i of a serpentine grid n wide. As the source divides, rows are fractions and turn back only where they are whole and odd... or, ``strict``, every other row."""
    row = F.floor(i / n) if strict else i / n
    ahead, back = i % n, n - i % n - 1
    return row, F.when(row % 2 == 0, ahead).otherwise(back)


def dls_to_lat_long(lsd: Column, section: Column, township: Column, range_: Column, meridian: Column, strict: bool = False) -> Column:
    """[L8] struct<n, w>: about the middle of a survey place, in degrees north and west."""
    zero = F.when(meridian.isin("1", "P"), F.lit(97.45789)).otherwise(4.0 * (meridian.try_cast("int") - 1) + 98)
    north, west = 6.0 * (township - 1), 6.0 * (range_ - 1)
    row, column = _step(section - 1, 6, strict)
    north, west = north + row, west + column
    number = lsd.try_cast("int")
    row, column = _step(number - 1, 4, strict)
    north = north + F.when(number.isNotNull(), row * 0.25).when(lsd.startswith("N"), 0.5).otherwise(0.0)
    west = west + F.when(number.isNotNull(), column * 0.25).when(lsd.endswith("W"), 0.5).otherwise(0.0)
    half = F.when(lsd.isNull(), 0.5).when(number.isNotNull(), 0.125).otherwise(0.25)
    n = 49 + F.degrees((north + half) / EARTH_MILES)
    w = zero + F.degrees((west + half) / (EARTH_MILES * F.cos(F.radians(n))))
    return F.struct(n.alias("n"), w.alias("w"))


def nts_key(series: Column, area: Column, sheet: Column) -> Column:
    return F.format_string("%03d%s%02d", series, F.upper(area), sheet)


def nts_to_lat_long(place: Column, box: Column, strict: bool = False) -> Column:
    """[L9] struct<n, w> of an NTS place in its sheet's box (lat1, long1, lat2, long2); join the boxes by ``nts_key``."""
    height, width = F.abs(box["lat1"] - box["lat2"]), F.abs(box["lon1"] - box["lon2"])
    row, column = _step(F.ascii(place["block"]) - 65, 4, strict)
    unit = place["unit"] - 1
    n = box["lat1"] + row * height / 3 + (F.floor(unit / 10) if strict else unit / 10) * height / 30
    w = box["lon1"] + column * width / 4 + unit % 10 * width / 40
    w = w + F.when(place["quarter"].isin("b", "c"), width / 80).otherwise(0.0)
    n = n + F.when(place["quarter"].isin("c", "d"), height / 60).otherwise(0.0)
    middle = (height / 120, width / 160) if strict else (width / 120, height / 160)  # the source mixes the two
    return F.struct((n + middle[0]).alias("n"), (w + middle[1]).alias("w"))


def histogram(places: DataFrame, doc: str, text: str, page: str) -> DataFrame:
    """[L12, A20] (doc, text, n, pages)"""
    return places.groupBy(doc, text).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(page)).alias("pages"))


def _groups(kind: str) -> list[int]:
    """The groups of a form that its text is made of; all hold only letters and digits."""
    return [1, 2, 4, 5, 7] if kind == "DLS" else [int(x.lstrip("#")) for x in RECORD_TEXT[kind] if x[0] != "="]


def _parts(kind: str, found: Column, pattern: str) -> Column:
    """The texts of these groups in a match, by one search."""
    return F.split(F.regexp_replace(found, pattern, "-".join(f"${i}" for i in _groups(kind))), "-")


def _formatted(kind: str, parts: Column, meridian: Column) -> tuple[Column, Column, Column]:
    """(text, whether it is too little for a place, whether it should be looked at) of the parts of a record's form."""
    g = lambda i: F.get(parts, F.lit(_groups(kind).index(i)))
    n = lambda i: g(i).cast("int").cast("string")
    no = F.lit(False)
    if kind == "DLS":
        w = F.when(g(7) != "", g(7)).otherwise(F.coalesce(F.nullif(F.substring(meridian, 2, 1), F.lit("")), F.lit("?")))
        return F.concat_ws("-", g(1), n(2), n(4), n(5), F.concat(F.lit("W"), w, F.lit("M"))), (g(1) == "") & (g(7) == ""), F.length(g(1)) != 2
    return F.concat(*(F.lit(x[1:]) if x[0] == "=" else n(int(x[1:])) if x[0] == "#" else g(int(x)) for x in RECORD_TEXT[kind])), no, no


def _entry(kind: str, shown: str, pattern: str, rests: Column, meridian: Column):
    """What the i-th match of a form comes to; ``rests`` has the text behind each."""

    def entry(m: Column, i: Column) -> Column:
        def whole(parts: Column, last: Column) -> Column:
            start, little, odd = _formatted(kind, parts, meridian)
            end, _, odd_end = _formatted(kind, last, meridian)
            ranged = last.isNotNull()
            return F.struct((i + 1).alias("no"), F.lit(shown).alias("format"), start.alias("start"), F.when(ranged, end).alias("end"), (odd | (ranged & odd_end)).alias("odd"), little.alias("little"))

        def last(rest: Column) -> Column:
            near = F.substring(rest, 1, 6)
            after = F.when(near.contains("to") | near.contains(":"), F.regexp_extract(rest, pattern, 0)).otherwise("")
            return let(after, lambda x: F.when(x != "", _parts(kind, x, pattern)))

        end = let(F.concat(F.right(m, F.lit(1)), F.get(rests, i)), last)
        return let(_parts(kind, m, pattern), lambda p: let(end, lambda q: whole(p, q)))

    return entry


def _entries(source: Column, kind: str, shown: str, pattern: str, meridian: Column) -> Column:
    """What the matches of a form in ``source`` come to; the text behind them is looked for only where there are any."""
    pattern = pattern.replace("[^a-zA-Z0-9]", r"\P{Alnum}")  # the same characters, told by one look-up
    none = F.array().cast("array<struct<no:int,format:string,start:string,end:string,odd:boolean,little:boolean>>")
    rests = F.regexp_extract_all(source, F.lit(f"({pattern})(?=(.*))"), F.lit(RECORD_GROUPS[kind] + 2))
    return let(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(rests, lambda r: F.transform(found, _entry(kind, shown, pattern, r, meridian)))).otherwise(none))


def extract_places(text: Column, meridian: Column) -> Column:
    """[L10] array<struct<no, format, start, end, check>>: the places of a record, form by form; null: none.

    White space doesn't count; in a survey place '1/4Sec' reads as a dash. 'to'
    or a colon in the last character of a place and the five after it make a
    range: the next place is its end and has no entry of its own (if none of its
    form follows, the next one of whatever form is passed over). ``no`` counts
    all places of a form. Sheets without a quarter unit are looked for only
    where no whole place is. A survey place needs a subdivision or a meridian;
    the second character of ``meridian`` stands in for a missing one. ``check``
    marks survey places from the first on whose subdivision isn't of two letters.
    """
    none = F.array().cast("array<struct<no:int,format:string,start:string,end:string,odd:boolean,little:boolean>>")

    def forms(raw: Column) -> Column:
        entries = {kind: _entries(F.replace(raw, F.lit("1/4Sec"), F.lit("-")) if kind == "DLS" else raw, kind, shown, pattern, meridian) for kind, shown, pattern in RECORD_FORMS}
        whole = entries.pop("NTS")
        rest = lambda w: [F.when(F.size(w) == 0, x).otherwise(none) if kind == "NTS1_3" else x for kind, x in entries.items()]
        return let(whole, lambda w: F.concat(w, *rest(w)))

    empty = F.array().cast("array<struct<no:int,format:string,start:string,end:string,check:boolean>>")
    first = F.struct(F.lit(False).alias("skip"), F.lit(False).alias("check"), empty.alias("out"))

    def step(state: Column, x: Column) -> Column:
        check = state["check"] | x["odd"]
        one = F.struct(x["no"].alias("no"), x["format"].alias("format"), x["start"].alias("start"), x["end"].alias("end"), check.alias("check"))
        taken = F.struct(x["end"].isNotNull().alias("skip"), check.alias("check"), F.concat(state["out"], F.array(one)).alias("out"))
        skipped = F.struct(F.lit(False).alias("skip"), state["check"].alias("check"), state["out"].alias("out"))
        return F.when(state["skip"], skipped).when(x["little"], state).otherwise(taken)

    return F.aggregate(let(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), forms), first, step, lambda state: state["out"])


def unknown_place(text: Column) -> Column:
    """[L11] Whether a text of more than two characters has none of the forms."""
    raw = F.regexp_replace(text, r"\s+", "")
    none = F.lit(True)
    for kind, _, pattern in RECORD_FORMS:
        none = none & ~(F.regexp_replace(raw, "1/4Sec", "-") if kind == "DLS" else raw).rlike(pattern)
    return F.coalesce(none & (F.length(text) > 2) & (text != "None"), F.lit(False))


def heading(line: Column) -> Column:
    """[H1] struct<kind, id> of a caption's label, null without one."""
    kind = F.regexp_extract(line, LABEL, 2)
    ident = F.coalesce(F.nullif(F.regexp_extract(line, LABEL, 3), F.lit("")), F.nullif(F.regexp_extract(line, LABEL, 4), F.lit("")))
    return F.when(kind != "", F.struct(F.lower(kind).alias("kind"), ident.alias("id")))


#: How a caption begins, and what keeps a line from being one.
CAPTION_WORDS = ("Table", "TABLE", "FIGURE", "FIGURES", "Figure", "Figures", "IMAGE", "IMAGES", "Image", "Images", "PHOTO", "PHOTOS", "Photo", "Photos")
NO_CAPTION = ("...", "Table of Content", "TABLE OF CONTENTS", "Table des matières", "TABLE DES MATIÈRES")
#: Titles of contents pages.
CONTENTS_TITLES = ("table of contents", "list of plates", "list of figures", "list of photos", "list of images", "list of tables", "list of appendices")


def captions(lines: DataFrame, doc: str, page: str, line: str, text: str) -> DataFrame:
    """[L13] Lines that begin like a caption, with the line after them, on the next page too.

    Line breaks don't count, nor do words of up to two characters at the front.
    """
    flat = F.regexp_replace(F.col(text), r"[\n\r]", "")
    words = F.array_join(F.filter(F.split(flat, " "), lambda t: F.length(t) > 2), " ")
    out = lines.withColumn("following", F.lead(F.regexp_replace(F.regexp_replace(F.col(text), "\n", " "), "\r", "")).over(Window.partitionBy(doc).orderBy(page, line)))
    begins, barred = F.lit(False), F.lit(False)
    for word in CAPTION_WORDS:
        begins = begins | words.startswith(word)
    for word in NO_CAPTION:
        barred = barred | F.col(text).contains(word)
    return out.where(begins & ~barred)


def contents_pages(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """[H2, W9] (doc, page): the pages of the table of contents.

    A page with a title of such a table, or with a line that is dots for more
    than 0.3 of it, is certain. From the first of these on, a page also counts
    if it has more than ten lines and more than 0.3 of them end in a number.
    The first run of consecutive pages is the table.
    """
    low = F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))))
    titled = F.lit(False)
    for title in CONTENTS_TITLES:
        titled = titled | low.contains(title)
    dots = F.length(low) - F.length(F.regexp_replace(low, r"\.{2,}", ""))
    sure = F.coalesce((F.length(low) > 0) & (titled | (dots > 0.3 * F.length(low))), F.lit(False))
    stats = lines.groupBy(doc, page).agg(F.max(sure).alias("sure"), F.count(F.lit(1)).alias("n"), F.count_if(low.rlike(r"\d+\z")).alias("ends"))
    w = Window.partitionBy(doc).orderBy(page)
    begun = stats.withColumn("begun", F.max("sure").over(w)).where("begun and (sure or (n > 10 and ends > 0.3 * n))")
    runs = begun.withColumn("gap", F.col(page) - F.row_number().over(w))
    return runs.withColumn("first", F.min("gap").over(Window.partitionBy(doc))).where("gap = first").select(doc, page)


def outline_rows(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """[S19] (doc, title, page, level, place): a document's outline as rows, in reading order.

    ``nodes`` has doc, node, parent (null at the top), position among its
    siblings, title, page. Levels count from 0; nodes that hang on nothing, or
    on each other, don't appear.
    """
    from docgrid.operators.trees import down

    slim = nodes.select(F.col(doc).alias("doc"), "node", "parent", F.format_string("%09d", F.col("position").cast("long")).alias("step"), "title", "page")
    out = down(slim, ["doc", "node"], "parent", F.col("step"))
    return out.select(F.col("doc").alias(doc), "title", "page", F.col("up").alias("level"), F.row_number().over(Window.partitionBy("doc").orderBy("path")).alias("place"))


# boxes: struct<x, y, w, h>


def crop_box(x: Column, y: Column, w: Column, h: Column, page_height: Column) -> Column:
    """PDF points to pixels at 300 dpi with y turned; halves to even."""
    k = 300 / 72
    return F.struct(*[F.bround(v * k).cast("int").alias(n) for v, n in ((x, "left"), (page_height - y - h, "top"), (x + w, "right"), (page_height - y, "bottom"))])


def to_points(x: Column, pdf: Column, page: Column) -> Column:
    """Pixels of a page picture to PDF points, cut."""
    return (x * pdf / page).cast("int")


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Two corners as (x1, y1, x2, y2) in order."""
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))


def overlaps(a: Column, b: Column) -> Column:
    """Touching counts."""
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])


def contains(a: Column, b: Column) -> Column:
    """[F38]"""
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (a["x"] + a["w"] >= b["x"] + b["w"]) & (a["y"] + a["h"] >= b["y"] + b["h"])


def from_canvas(x: Column, y: Column, w: Column, h: Column, canvas_w: Column, canvas_h: Column, page_w: Column, page_h: Column) -> Column:
    """struct<x, y, w, h>: a canvas box, its origin at the top left, on a page whose origin is at the bottom left."""
    sx, sy = page_w / canvas_w, page_h / canvas_h
    return F.struct((x * sx).alias("x"), (page_h - (y + h) * sy).alias("y"), (w * sx).alias("w"), (h * sy).alias("h"))


def nearest_label(items: DataFrame, labels: DataFrame, page: str, x: str = "x", y: str = "y") -> DataFrame:
    """[O8, H6] Each item with the nearest label of its page."""
    l = labels.select(page, F.col("label"), F.col(x).alias("lx"), F.col(y).alias("ly"))
    far = F.sqrt(F.pow(F.col(x) - F.col("lx"), 2) + F.pow(F.col(y) - F.col("ly"), 2))
    return items.join(l, page).groupBy(*items.columns).agg(F.min_by("label", F.struct(far, "label")).alias("label"))


def straight_share(lines: DataFrame, by: str) -> DataFrame:
    """Share of the length in horizontal or vertical lines; 0.99 and more tells a table."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    share = F.sum(F.when((dx == 0) | (dy == 0), dx + dy).otherwise(0)) / F.sum(dx + dy)
    return lines.groupBy(by).agg(share.alias("share"), (share >= 0.99).alias("is_table"))


def document_title(lines: DataFrame, doc: str, line: str, text: str, height: str) -> DataFrame:
    """[H4] (doc, title): the line that a subject or 're:' mark begins, else the one after 'dear' or 'to:', else the tallest; the first of equals."""
    w = Window.partitionBy(doc).orderBy(line)
    marked = F.regexp_extract(text, r"(?i)^\s*(?:subject|title|re)\s*:\s*(.+)$", 1)
    before = F.coalesce(F.lag(text).over(w).rlike(r"(?i)^\s*(?:dear\b|to:)"), F.lit(False))
    rank = F.when(marked != "", 0).when(before, 1).otherwise(2)
    rows = lines.withColumns({"title": F.when(marked != "", F.trim(marked)).otherwise(F.trim(F.col(text))), "rank": rank})
    best = F.struct("rank", F.when(F.col("rank") == 2, -F.col(height)).otherwise(F.lit(0.0)), line)
    return rows.where(F.col("title") != "").groupBy(doc).agg(F.min_by("title", best).alias("title"))
