"""Grid algebra: captured tables as ``array<array<string>>`` columns, row 0 the header.

Every function maps columns to a column by higher-order functions, so a grid is
cleaned within whole-stage projections and never leaves its row. Null grids
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = "array<array<string>>"
ADDED = ("VEC", "GIS", "Topic")
#: Columns from the right that hold each kind of section label.
SECTION_COLUMN = {"VEC": 3, "GIS": 2, "Topic": 1}
#: Headings that a capture cuts off, and what they are.
CUT_HEADINGS = {"egal Land Description": "Legal Land Description", "nvironmental Issues": "Environmental Issues", "EnvironmentalIssues": "Environmental Issues"}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` names it.

    An aggregate of no rows that begins with the value; an element of an array
    made of it would ask for the whole expression's type again in every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_content(cell: Column) -> Column:
    """[G1] Any character that isn't white space; null has none."""
    return F.coalesce(cell.rlike(r"\S"), F.lit(False))


def cells(grid: Column, change) -> Column:
    return F.transform(grid, lambda r: F.transform(r, change))


def first_column_empty(grid: Column) -> Column:
    """[G2] No row, the header included, has content in its first cell."""
    return F.forall(grid, lambda r: ~has_content(F.get(r, F.lit(0))))


def drop_first_column(grid: Column) -> Column:
    """[G3]"""
    return F.transform(grid, lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))))


def drop_last_column(grid: Column, n: int = 1) -> Column:
    """[G3]"""
    return F.transform(grid, lambda r: F.slice(r, 1, F.greatest(F.size(r) - n, F.lit(0))))


def drop_first_row(grid: Column) -> Column:
    """[G4]"""
    return F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))


def drop_last_row(grid: Column) -> Column:
    """[G4]"""
    return F.slice(grid, 1, F.greatest(F.size(grid) - 1, F.lit(0)))


def drop_notes(grid: Column) -> Column:
    """[G5] Without the last row, and without the first column if that is empty then."""
    return let(drop_last_row(grid), lambda rest: F.when(first_column_empty(rest), drop_first_column(rest)).otherwise(rest))


def repair_headings(grid: Column) -> Column:
    """[G6] Cut-off headings as they should read, in any cell."""
    known = F.create_map(*[F.lit(x) for pair in CUT_HEADINGS.items() for x in pair])
    return cells(grid, lambda c: F.coalesce(F.try_element_at(known, c), c))


def merge_header_rows(grid: Column) -> Column:
    """[G7] Two header rows as one: the last label of the upper row that has content, before the lower cell where they differ."""
    upper, lower = F.get(grid, F.lit(0)), F.get(grid, F.lit(1))

    def label(i: Column) -> Column:
        seen = F.filter(F.slice(upper, 1, i + 1), has_content)
        return F.coalesce(F.try_element_at(seen, F.lit(-1)), F.get(upper, F.lit(0)))

    merged = F.transform(lower, lambda c, i: F.when(label(i) == c, c).otherwise(F.concat(label(i), F.lit(" "), c)))
    return F.when(F.size(grid) > 1, F.concat(F.array(merged), F.slice(grid, 3, F.greatest(F.size(grid) - 2, F.lit(0))))).otherwise(grid)


def add_label_columns(grid: Column) -> Column:
    """[G8] Three columns more on the right, empty below their headers."""
    header, blank = F.array(*map(F.lit, ADDED)), F.array(*[F.lit("")] * 3)
    return F.transform(grid, lambda r, i: F.concat(r, F.when(i == 0, header).otherwise(blank)))


def is_section(row: Column) -> Column:
    return ~F.exists(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), has_content)


def sections(grid: Column) -> Column:
    """[G9] array<struct<label, at>> of rows below the header whose cells after the first are all blank."""
    marked = F.transform(grid, lambda r, i: F.struct(F.get(r, F.lit(0)).alias("label"), i.alias("at"), ((i > 0) & is_section(r)).alias("is")))
    return F.transform(F.filter(marked, lambda s: s["is"]), lambda s: F.struct(s["label"].alias("label"), s["at"].alias("at")))


def set_from_right(row: Column, n: int, value: Column) -> Column:
    return F.transform(row, lambda c, i: F.when(i == F.size(row) - n, value).otherwise(c))


def copy_down(grid: Column, found: Column, n: int) -> Column:
    """[G10] Each section's label in the n-th column from the right, from its row on until the next one."""

    def row(r: Column, i: Column) -> Column:
        above = F.filter(found, lambda s: s["at"] <= i)
        return F.when(F.size(above) > 0, set_from_right(r, n, F.try_element_at(above, F.lit(-1))["label"])).otherwise(r)

    return F.transform(grid, row)


def drop_rows(grid: Column, found: Column) -> Column:
    """[G11]"""
    return F.filter(grid, lambda r, i: ~F.exists(found, lambda s: s["at"] == i))


def sections_to_column(grid: Column, kind: str) -> Column:
    """[G12] Section rows become values of the kind's column.

    Labels that an earlier kind has put into its column count as content, so
    only sections above the first one can follow as another kind.
    """
    return let(sections(grid), lambda found: drop_rows(copy_down(grid, found, SECTION_COLUMN[kind]), found))


def first_row_to_column(grid: Column, kind: str = "Topic") -> Column:
    """[G13] The first row's first cell becomes the kind's value in all rows below the next; earlier labels are lost."""
    label = F.get(F.get(grid, F.lit(0)), F.lit(0))
    rest = add_label_columns(drop_last_column(drop_first_row(grid), 3))
    return F.transform(rest, lambda r, i: F.when(i >= 1, set_from_right(r, SECTION_COLUMN[kind], label)).otherwise(r))


def fill_nulls(grid: Column) -> Column:
    """[G14, G19] Null cells as '', others stripped."""
    return cells(grid, lambda c: F.coalesce(strip(c), F.lit("")))


def process(grid: Column, tags: Column, chain_tags: Column, manual: Column) -> Column:
    """[G15] The rewriting that a table's tags ask for, in the order of the source.

    Tag 13 takes the manual grid and stops. ``chain_tags`` are the tags of the
    whole chain: any of 5, 12, 14, 15 adds the three columns to all its tables.
    """

    def step(g: Column, tag: int, change) -> Column:
        return let(g, lambda x: F.when(F.array_contains(tags, tag), change(x)).otherwise(x))

    g = repair_headings(fill_nulls(grid))
    for tag, change in ((6, drop_notes), (7, drop_first_row), (8, drop_last_row), (9, drop_first_column), (10, drop_last_column), (11, merge_header_rows)):
        g = step(g, tag, change)
    wanted = F.arrays_overlap(chain_tags, F.array(*map(F.lit, (5, 12, 14, 15))))
    g = let(g, lambda x: F.when(wanted, add_label_columns(x)).otherwise(x))
    for tag, kind in ((5, "VEC"), (14, "GIS"), (15, "Topic")):
        g = step(g, tag, lambda x, kind=kind: sections_to_column(x, kind))
    g = step(g, 12, first_row_to_column)
    return F.when(F.array_contains(tags, 13), manual).otherwise(g)


def odd_rows(grid: Column, width: Column) -> Column:
    """[G16] Places of rows whose width isn't that of the chain's header."""
    marked = F.transform(grid, lambda r, i: F.struct(i.alias("at"), F.size(r).alias("width")))
    return F.transform(F.filter(marked, lambda s: s["width"] != width), lambda s: s["at"])


def stitch(parts: Column) -> Column:
    """[G17] One grid of a chain: array<struct<level, grid, no_header, append_status>>, in any order.

    The first level's grid begins; of the others the header goes unless they
    have none. With append status 2 the first row continues the last row
    before it, cell by cell, blank cells not.
    """
    ordered = F.array_sort(parts)

    def join(last: Column, first: Column) -> Column:
        return F.zip_with(last, first, lambda a, b: F.when(F.coalesce(b, F.lit("")) == "", a).otherwise(F.concat(strip(a), F.lit(" "), strip(b))))

    def add(done: Column, p: Column) -> Column:
        body = F.when(p["no_header"], p["grid"]).otherwise(drop_first_row(p["grid"]))
        merged = F.concat(drop_last_row(done), F.array(join(F.try_element_at(done, F.lit(-1)), F.get(body, F.lit(0)))), drop_first_row(body))
        plain = F.concat(done, body)
        return F.when((p["append_status"] == 2) & (F.size(body) > 0) & (F.size(done) > 0), merged).otherwise(plain)

    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.get(ordered, F.lit(0))["grid"], add)


def combine(parts: Column) -> Column:
    """[G18] Grids of one table over several PDFs, array<struct<level, grid>>: all headers but the first go."""
    ordered = F.array_sort(parts)
    rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(ordered, F.lit(0))["grid"], lambda done, p: F.concat(done, drop_first_row(p["grid"])))


def fill_down(grid: Column) -> Column:
    """[G20, W2] In the last three columns an empty cell takes the value above it; the header stays out of it."""

    def cell(c: Column, r: Column, i: Column, j: Column) -> Column:
        above = F.filter(F.slice(grid, 2, F.greatest(i, F.lit(0))), lambda x: F.coalesce(F.get(x, j), F.lit("")) != "")
        fill = (i > 1) & (j >= F.size(r) - 3) & (F.coalesce(c, F.lit("")) == "") & (F.size(above) > 0)
        return F.when(fill, F.get(F.try_element_at(above, F.lit(-1)), j)).otherwise(c)

    return F.transform(grid, lambda r, i: F.transform(r, lambda c, j: cell(c, r, i, j)))


def clean_capture(grid: Column) -> Column:
    """[G21] '(cid:n)' as a space, then without blank rows and blank columns."""
    g = cells(grid, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\(cid:\d+\)", " "))
    g = F.filter(g, lambda r: F.exists(r, has_content))
    return let(g, lambda x: F.transform(x, lambda r: F.filter(r, lambda c, j: F.exists(x, lambda y: has_content(F.get(y, j))))))


def metadata(grid: Column) -> Column:
    """[G22] struct<headers, n_rows, n_columns, text>; null for a grid without rows or columns."""
    head = F.get(grid, F.lit(0))
    out = F.struct(F.to_json(head).alias("headers"), F.size(grid).alias("n_rows"), F.size(head).alias("n_columns"), F.to_json(grid).alias("text"))
    return F.when((F.size(grid) > 0) & (F.size(head) > 0), out)


def header_key(cell: Column) -> Column:
    """[G23] A header without case, struck-out notes and marks."""
    c = F.regexp_replace(F.lower(cell), r"<s>\d+</s>", "")
    return F.regexp_replace(F.regexp_replace(c, r"</?s>", ""), r"[^a-z0-9]", "")


def meridian(grid: Column) -> Column:
    """[G27] The first W<digit>[M] of the last header that has one, in capitals; '' if none has."""
    hits = F.transform(F.get(grid, F.lit(0)), lambda c: F.regexp_extract(F.lower(c), r"w\dm?", 0))
    return F.upper(F.coalesce(F.try_element_at(F.filter(hits, lambda h: h != ""), F.lit(-1)), F.lit("")))


def unstrike(c: Column, loose: bool = False) -> Column:
    """[G28] Without strike-out marks, hard spaces as spaces; ``loose``: lower case, '(s)' as 's'."""
    c = F.replace(F.regexp_replace(c, r"</?s>", ""), F.lit(" "), F.lit(" "))
    return F.replace(F.lower(c), F.lit("(s)"), F.lit("s")) if loose else c


def annotate(grid: Column, names: list[str], values: list[Column], front: bool = True) -> Column:
    """[G29] Columns more, their names in the header."""
    head, body = F.array(*map(F.lit, names)), F.array(*[v.cast("string") for v in values])
    more = lambda i: F.when(i == 0, head).otherwise(body)
    return F.transform(grid, lambda r, i: F.concat(more(i), r) if front else F.concat(r, more(i)))


def drop_named_column(grid: Column, name: str) -> Column:
    """[G29] Without the first column of that header."""

    def without(g: Column) -> Column:
        at = F.array_position(F.get(g, F.lit(0)), name)
        return let(at, lambda k: F.when(k > 0, F.transform(g, lambda r: F.filter(r, lambda c, j: j != k - 1))).otherwise(g))

    return let(grid, without)


def equal(a: Column, b: Column) -> Column:
    """[G30] Same cells in the same places; two nulls aren't equal."""
    return a.isNotNull() & b.isNotNull() & a.eqNullSafe(b)


def row_class(grid: Column, no_header: Column, append_status: Column) -> Column:
    """[G32] Of each row: 'dropped' for a header that goes, 'merged' for a row that continues the last, else 'kept'."""
    first = F.when(no_header, F.lit(0)).otherwise(F.lit(1))
    return F.transform(grid, lambda r, i: F.when(i < first, F.lit("dropped")).when((i == first) & (append_status == 2), F.lit("merged")).otherwise(F.lit("kept")))


def blank_cells(grid: Column) -> Column:
    """[A26] Of each column the number of cells without a letter or digit."""
    return F.transform(F.get(grid, F.lit(0)), lambda c, j: F.size(F.filter(grid, lambda r: ~F.coalesce(F.get(r, j).rlike("[a-zA-Z0-9]"), F.lit(False)))))
