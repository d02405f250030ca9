"""Page layout: rows of contents pages, captions over several lines, pictures and their captions, boxes of a picture.

Everything ordered is told by windows over a page's or a document's lines:
what was open before a line, which run it belongs to, where a run ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.places import LABEL, heading

#: A caption of tables begins so.
TABLE_WORDS = ("table", "appendix")
#: Widths of a table and its continuation differ by less; a map or diagram covers at least so much of its page; a caption has so many letters.
SAME_WIDTH, LARGE, LETTERS = 5, 0.7, 5
#: From so many boxes on a picture is left whole; boxes up to so many pixels wide or high are marks.
MANY, TINY = 10, 20


def _joined(text: Column, order: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), " ")


def label_key(text: Column) -> Column:
    """The label of a text as a key, like ``table1.2``; null without one."""
    h = heading(text)
    return F.when(h.isNotNull(), F.concat(h["kind"], F.lower(h["id"])))


def contents_rows(lines: DataFrame, doc: str = "doc_id", page: str = "page", line: str = "line", text: str = "text") -> DataFrame:
    """[H3] (doc, page, row, text): the rows of contents pages, put together again.

    A line with a label opens a row, a line with leader dots ends it; lines
    between belong to the open row, lines outside are left out unless they have
    leaders. Null texts are empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = Window.partitionBy(doc, page).orderBy(line)
    dotted, labelled = t.rlike(r"\.{2,}"), t.rlike(LABEL)
    marked = lines.select(doc, page, line, t.alias("__t"), dotted.alias("__d"), (labelled & ~dotted).alias("__l"))
    state = F.when(F.col("__d"), 0).when(F.col("__l"), 1)  # after the line: a row is open or not; null: as before
    before = F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = marked.withColumn("__open", before).where("__d or __l or __open = 1")
    first = F.col("__l") | (F.col("__d") & (F.col("__open") == 0))
    rows = kept.withColumn("row", F.sum(first.cast("int")).over(w))
    return rows.groupBy(doc, page, "row").agg(_joined(F.col("__t"), F.col(line)).alias("text"))


def contents_labels(rows: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """[H3] (doc, label, title, shown_page): what a contents table says of each label; of several rows the last one.

    ``shown_page`` is the number behind the leaders, null without one.
    """
    found = F.regexp_extract("text", LABEL, 1)
    after = F.get(F.split(F.col("text"), F.concat(F.lit(r"\Q"), found, F.lit(r"\E")), 3), F.lit(1))
    title = F.trim(F.regexp_replace(after, r"(?:\.{2,})+.*", ""))
    out = rows.select(doc, page, "row", label_key(F.col("text")).alias("label"), title.alias("title"), F.regexp_extract("text", r"\.{2,}\s*(\d+)\s*$", 1).try_cast("int").alias("shown_page")).where("label is not null")
    last = F.max_by(F.struct("title", "shown_page"), F.struct(page, "row"))
    return out.groupBy(doc, "label").agg(last.alias("x")).select(doc, "label", "x.title", "x.shown_page")


def captions(lines: DataFrame, by: str = "height", doc: str = "doc_id", page: str = "page", line: str = "line", text: str = "text") -> DataFrame:
    """[H5] (doc, page, line, text, lines): captions with all of their lines.

    A line that begins with a label starts a caption. The lines after it
    belong to it up to the next label or the first line of another ``height``;
    with ``by`` as ``fonts``, an array, up to the first line in a font that the
    start doesn't have. Lines of up to three characters (raised or lowered
    signs) never end one. Null texts are empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = Window.partitionBy(doc, page).orderBy(line)
    starts = t.rlike(r"^(?:" + LABEL + ")")
    rows = lines.select(doc, page, line, t.alias("__t"), F.col(by).alias("__h"), starts.alias("__s")).withColumn("__n", F.sum(F.col("__s").cast("int")).over(w)).where("__n > 0")
    own = Window.partitionBy(doc, page, "__n").orderBy(line)
    head = F.first("__h").over(own)
    other = F.size(F.array_except("__h", head)) > 0 if by == "fonts" else ~F.col("__h").eqNullSafe(head)
    rows = rows.withColumn("__x", other & (F.length("__t") > 3))
    rows = rows.withColumn("__ended", F.max("__x").over(own)).where("not __ended")
    return rows.groupBy(doc, page, "__n").agg(F.min(line).alias(line), F.trim(_joined(F.col("__t"), F.col(line))).alias("text"), F.count(F.lit(1)).alias("lines")).drop("__n")


def _fits(is_table: Column, text: Column) -> Column:
    """Tables go with captions of tables, other pictures with others."""
    low = F.lower(text)
    return is_table == (low.startswith(TABLE_WORDS[0]) | low.startswith(TABLE_WORDS[1]))


def _by_layout(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, page, image, text): captions before or after each picture, where a page's first and last elements tell the layout."""
    none = F.lit(None).cast("string")
    elements = labels.select("doc_id", "page", F.col("cy").alias("at"), F.lit(0).alias("kind"), F.col("label").alias("no"), "text", F.lit(None).cast("boolean").alias("is_table")).unionByName(
        images.select("doc_id", "page", (F.col("y") + F.col("h") / 2).alias("at"), F.lit(1).alias("kind"), F.col("image").alias("no"), none.alias("text"), "is_table")
    )
    w = Window.partitionBy("doc_id", "page").orderBy("at", "kind", "no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = elements.select(
        "*", F.first("kind").over(whole).alias("top"), F.last("kind").over(whole).alias("end"), F.lag("text").over(w).alias("above"), F.lead("text").over(w).alias("below")
    ).where("kind = 1 and top <> end")  # a label first and a picture last: captions stand above
    found = near.withColumn("text", F.when(F.col("top") == 0, F.col("above")).otherwise(F.col("below"))).where(_fits(F.col("is_table"), F.col("text")))
    return found.select("doc_id", "page", F.col("no").alias("image"), "text")


def _by_distance(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, page, image, text): the nearest caption of the picture's kind; those inside a table count only if all are."""
    l = labels.select("doc_id", "page", F.col("label").alias("no"), "cx", "cy", "text")
    inside = F.col("is_table") & F.col("cx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("h"))
    pairs = images.select("doc_id", "page", "image", "x", "y", "w", "h", "is_table").join(l, ["doc_id", "page"]).withColumn("inside", inside)
    outside = F.min("inside").over(Window.partitionBy("doc_id", "page", "image"))
    far = F.sqrt(F.pow(F.col("x") + F.col("w") / 2 - F.col("cx"), 2) + F.pow(F.col("y") + F.col("h") / 2 - F.col("cy"), 2))
    valid = pairs.withColumn("most", outside).where("inside = most").where(_fits(F.col("is_table"), F.col("text")))
    return valid.groupBy("doc_id", "page", "image").agg(F.min_by("text", F.struct(far, "no")).alias("text"))


def _continued(images: DataFrame) -> DataFrame:
    """(doc, page, image, text): captions of tables that go on from the last table of the page before, of the same width.

    The last tables of following pages hand a caption on; a run of them begins
    where one has a caption of its own, or isn't like the one before.
    """
    tables = images.where("is_table")
    ends = tables.groupBy("doc_id", "page").agg(F.max_by(F.struct("w", "text"), "image").alias("t")).select("doc_id", "page", "t.w", "t.text")
    w = Window.partitionBy("doc_id").orderBy("page")
    goes_on = (F.lag("page").over(w) == F.col("page") - 1) & (F.abs(F.col("w") - F.lag("w").over(w)) < SAME_WIDTH) & F.col("text").isNull()
    runs = ends.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    carried = runs.withColumn("held", F.first("text").over(Window.partitionBy("doc_id", "run").orderBy("page"))).select("doc_id", (F.col("page") + 1).alias("page"), F.col("w").alias("before"), "held")
    rest = tables.where("text is null").select("doc_id", "page", "image", "w").join(carried, ["doc_id", "page"])
    return rest.where((F.abs(F.col("w") - F.col("before")) < SAME_WIDTH) & F.col("held").isNotNull()).select("doc_id", "page", "image", F.col("held").alias("text"))


def _large(images: DataFrame, lines: DataFrame, by: Callable[..., DataFrame]) -> DataFrame:
    """(doc, page, image, text): of pictures that fill a page, the largest writing in its lowest fifth with enough letters, else the last one looked at; ``by`` deals rows by keys."""
    big = images.where(f"not is_table and text is null and w * h >= {LARGE} * page_w * page_h").select("doc_id", "page", "image", "page_h")
    on = lines.select("doc_id", "page", "line", F.coalesce("text", F.lit("")).alias("t"), "y", "height", "font").join(big.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    long_ = F.length("t") > 3
    # the runs of one height among long lines; a line's extent ends where the run does that its own height goes on in
    rows = on.withColumn("next", F.min_by(F.when(long_, F.struct("line", "height")), F.when(long_, F.col("line"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    changes = rows.where(long_).withColumn("ends", F.when(~F.col("next.height").eqNullSafe(F.col("height")), F.col("next.line")))
    after = F.min("ends").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ends = changes.select("doc_id", "page", F.col("line").alias("__l"), after.alias("end"))
    at = F.when(long_, F.col("line")).when(F.col("next.height").eqNullSafe(F.col("height")), F.col("next.line"))
    seeds = by(rows.withColumn("__l", at).withColumn("stop", F.when(~long_ & F.col("__l").isNull(), F.col("next.line"))), "doc_id", "page", "__l").join(ends, ["doc_id", "page", "__l"], "left").withColumn("end", F.coalesce("stop", "end"))
    every = on.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("all"))  # of one page
    inside = F.filter("all", lambda x: (x["line"] >= F.col("line")) & (F.col("end").isNull() | (x["line"] < F.col("end"))))
    seeds = by(seeds, "doc_id", "page").join(every, ["doc_id", "page"]).withColumn("text", F.trim(F.array_join(F.transform(inside, lambda x: x["t"]), " ")))
    met = big.join(seeds.select("doc_id", "page", "line", "y", "font", "text"), ["doc_id", "page"]).withColumn("low", F.col("y") <= F.col("page_h") / 5)
    met = met.withColumn("some", F.max("low").over(Window.partitionBy("doc_id", "page", "image"))).where("low or not some")
    enough = F.length(F.regexp_replace(F.lower("text"), "[^a-z]", "")) >= LETTERS
    return met.groupBy("doc_id", "page", "image").agg(F.coalesce(F.min_by(F.when(enough, F.col("text")), F.when(enough, F.struct(-F.col("font"), "line"))), F.max_by("text", F.struct(-F.col("font"), "line"))).alias("text"))


def tag_images(images: DataFrame, labels: DataFrame, contents: DataFrame, lines: DataFrame, parts: int | None = None) -> DataFrame:
    """[H6] (doc_id, page, image, text, way, title): pictures with their captions, how they were found, and the contents table's title of the same label.

    ``images`` has doc_id, page, image (its number from the top), x, y, w, h,
    is_table, page_w, page_h; ``labels`` doc_id, page, label (its number), cx,
    cy, text; ``contents`` doc_id, label, title; ``lines`` doc_id, page, line,
    text, y, height, font, for pictures that fill a page. In turn: the layout of
    the page, the nearest caption, the table that goes on from the page before,
    the large writing under a map. A picture without any keeps null. ``parts``
    is the number of partitions in which the pictures meet what was found; none:
    as many as Spark likes.
    """
    on = ["doc_id", "page", "image"]
    by = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    some = labels.where("text is not null")
    first = _by_layout(images, some).withColumnRenamed("text", "t1")
    near = _by_distance(images, some).withColumnRenamed("text", "t2")
    known = by(images, *on).join(first, on, "left").join(near, on, "left").withColumn("text", F.coalesce("t1", "t2"))
    more = _continued(known).withColumnRenamed("text", "t3")
    maps = _large(known, lines, by).withColumnRenamed("text", "t4")
    out = known.drop("text").join(more, on, "left").join(maps, on, "left")
    way = F.when(F.col("t1").isNotNull(), "layout").when(F.col("t2").isNotNull(), "nearest").when(F.col("t3").isNotNull(), "page before").when(F.col("t4").isNotNull(), "largest")
    out = out.select(*on, F.coalesce("t1", "t2", "t3", "t4").alias("text"), way.alias("way")).withColumn("label", label_key(F.col("text")))
    return by(out, "doc_id", "label").join(contents.select("doc_id", "label", "title"), ["doc_id", "label"], "left").select(*on, "text", "way", "title")


def _components(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, picture: np.ndarray | None = None) -> np.ndarray:
    """Which boxes of a picture hang together by overlaps, edges included: a sweep from left to right over the boxes that are open, picture after picture."""
    picture = np.zeros(len(x0), np.int64) if picture is None else picture
    order = np.lexsort((x0, picture))
    parent = np.arange(len(x0))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    open_ = np.empty(0, np.int64)
    now = None
    for i in order:
        if picture[i] != now:
            open_, now = open_[:0], picture[i]
        open_ = open_[x1[open_] >= x0[i]]
        for j in open_[(y0[open_] <= y1[i]) & (y1[open_] >= y0[i])]:
            parent[root(int(j))] = root(int(i))
        # a box inside another open one of its component can't meet anything that the other doesn't
        hidden = (x1[open_] <= x1[i]) & (y0[open_] >= y0[i]) & (y1[open_] <= y1[i])
        open_ = np.append(open_[~hidden], i)
        if len(open_) > 1 and ((x1[open_[:-1]] >= x1[i]) & (y0[open_[:-1]] <= y0[i]) & (y1[open_[:-1]] >= y1[i])).any():
            open_ = open_[:-1]
    return np.array([root(i) for i in range(len(x0))])


def merge_boxes(boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, x, y, w, h): boxes that hang together by overlaps (touching counts) as the box around them; boxes inside another are gone.

    The boxes of a picture come to one task as a few numbers each, many
    pictures in one sweep; a sweep needs memory for the boxes alone.
    """
    kind = boxes.schema[image].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged(table: pa.Table, end: bool) -> Iterator[pa.RecordBatch]:
            """The pictures of sorted rows, but for the last one unless these are the end."""
            names = table[image].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names))
            upto = len(names) if end else int(edge[-2])
            held[:] = table.slice(upto).to_batches()
            if not upto:
                return
            rows = table.slice(0, upto)
            x, y, w, h = (rows[c].to_numpy() for c in ("x", "y", "w", "h"))
            picture = np.repeat(np.arange(len(edge) - 1), np.diff(edge))[:upto]
            part = _components(x, y, x + w, y + h, picture)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            b = np.stack([f.reduceat(v[order], first) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x + w), (np.maximum, y + h))], axis=1)
            of = picture[order[first]]
            order = np.argsort(of, kind="stable")
            b, of = b[order], of[order]
            begin = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
            kept = np.concatenate([i + np.fromiter(_outer(b[i:k]), np.int64) if k - i > 1 else np.array([i]) for i, k in zip(begin[:-1], begin[1:])])
            b, of = b[kept], of[kept]
            out = pa.table([rows[image].take(pa.array(edge[of])), *map(pa.array, (b[:, 0], b[:, 1], b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]))], names=[image, "x", "y", "w", "h"])
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            yield from merged(pa.Table.from_batches(held), False)
        if held:
            yield from merged(pa.Table.from_batches(held), True)

    slim = boxes.select(image, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")))
    return slim.repartition(image).sortWithinPartitions(image).mapInArrow(run, f"{image} {kind}, x double, y double, w double, h double")


def _outer(b: np.ndarray) -> Iterator[int]:
    """Boxes that no other contains; equal boxes can't be, they overlap."""
    for i in range(len(b)):
        within = (b[:, 0] <= b[i, 0]) & (b[:, 1] <= b[i, 1]) & (b[:, 2] >= b[i, 2]) & (b[:, 3] >= b[i, 3])
        if within.sum() == 1:
            yield i


def picture_parts(boxes: DataFrame, pictures: DataFrame, image: str = "image_id") -> DataFrame:
    """[H7] (image, x, y, w, h): the parts of each picture.

    Ten boxes and more mean that the split failed: the picture stays whole.
    Otherwise boxes of up to 20 pixels in width or height
    are left out, the rest merged. ``pictures`` has image, w, h.
    """
    counts = boxes.groupBy(image).agg(F.count(F.lit(1)).alias("__n"))
    whole = pictures.join(counts.where(F.col("__n") >= MANY), image).select(image, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    few = boxes.join(counts.where(F.col("__n") < MANY), image, "left_semi").where((F.col("w") > TINY) & (F.col("h") > TINY))
    return merge_boxes(few, image).unionByName(whole)
