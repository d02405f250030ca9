"""Hard negatives by one-dimensional distance keys.

Inner products become distances: a row x is given one more component,
sqrt(M - |x|²) with M the greatest |x|² of the table, a query gets 0, and the
nearest rows are those of the greatest inner product. Every row belongs to its
nearest pivot; its key is (pivot, distance to the pivot). The index is a table
sorted by that key, in blocks of rows of one pivot and one ring of distances.

A query looks at an annulus around itself. Where the annulus lies, the triangle
inequality leaves one interval of keys for each pivot; the interval's rings are
joined with the index, blocks are scored as matrix products, and the interval
grows until no row outside it can be among the first k. The last round covers
whatever is left, so results are exact for any data; pivots only decide how
much is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import cut

#: Rows and components on which pivots and radii are fitted (at most); every row is indexed.
SAMPLE_ROWS, SAMPLE_VALUES = 4096, 1 << 20
#: Rows in a block, queries in a group.
BLOCK, GROUP = 512, 256
#: Shares of the table's distances at which a search may stop, and how many of them each round goes on by.
REACH = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
ROUNDS = (1, 2)
#: Room for rounding, relative to the greatest length.
SLACK = 1e-6


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` numbers; short lists are filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (n == dim).all():
        return values.reshape(len(n), dim).astype(np.float64)
    out = np.zeros((len(n), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def _bytes(x: np.ndarray) -> bytes:
    """Numbers in half the room where that keeps them."""
    half = x.astype(np.float32)
    return (half if (half == x).all() else x).tobytes()


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


@dataclass(frozen=True)
class Index:
    blocks: DataFrame  # (pivot, ring, n, first, ids, labels, vectors, anchors), sorted by key
    dim: int
    most: float  # the greatest |x|²
    pivots: np.ndarray  # with the additional component
    width: float  # of a ring
    rings: np.ndarray  # (pivots, 2): the first and last ring that has rows
    reach: np.ndarray  # radii at the shares of REACH, then infinity

    @property
    def slack(self) -> float:
        return SLACK * max(1.0, self.most**0.5)


def _fit(sample: np.ndarray, pivots: int) -> np.ndarray:
    """A few rounds of Lloyd's algorithm from rows spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, pivots).astype(int)]
    for _ in range(6):
        own = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=pivots)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build_index(rows: DataFrame) -> Index:
    """The index of ``rows`` (id, label, vector array<double>, anchor boolean) without nulls but in ``id``."""
    kind = rows.schema["id"].dataType.simpleString()
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(length)).first()
    dim, most = max(dim or 0, 1), most or 0.0
    some = max(64, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    picked = rows.select("vector", F.xxhash64("id", "vector").alias("h")).orderBy("h").limit(some).select("vector").toArrow()["vector"].combine_chunks()
    sample = _vectors(picked, dim) if len(picked) else np.zeros((1, dim))
    extra = lambda x: np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]
    full = np.hstack([sample, extra(sample)])
    count = min(len(full), int(np.clip(n**0.5 / 8, 4, 256)))
    pivots = _fit(full, count)
    away = lambda x: np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))
    own = away(full).min(1)
    width = float(own.max() - own.min()) / int(np.clip(n / count / BLOCK, 1, 64)) or 1.0
    probes = sample[:: max(1, len(sample) // 64)]
    far = np.sqrt(np.maximum(most + (probes**2).sum(1)[:, None] - 2 * probes @ sample.T, 0))
    reach = np.append(np.quantile(far, REACH), np.inf)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _vectors(part.column(2), dim)
                d = away(np.hstack([x, extra(x)]))
                near = d.argmin(1)
                key = d[np.arange(len(x)), near]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(key), pa.array(np.floor(key / width).astype(np.int64))], names=["id", "label", "vector", "anchor", "pivot", "distance", "ring"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 33

        def block(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            number += part.num_rows
            one = lambda c, k: pa.array([c], k)
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in (0, 1, 3)]
            x = _vectors(part.column(2), dim)
            columns = [part.column(4).slice(0, 1), part.column(6).slice(0, 1), one(part.num_rows, pa.int32()), one(number - part.num_rows, pa.int64()), lists[0], lists[1], one(_bytes(x), pa.binary()), lists[2]]
            return pa.RecordBatch.from_arrays(columns, names=["pivot", "ring", "n", "first", "ids", "labels", "vectors", "anchors"])

        def runs(end: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if not table.num_rows:
                return
            rows_ = table.to_batches()[0]
            pivot, ring = rows_.column(4).to_numpy(), rows_.column(6).to_numpy()
            edge = np.flatnonzero((pivot[1:] != pivot[:-1]) | (ring[1:] != ring[:-1])) + 1
            begin = 0
            for to in [*edge.tolist(), len(pivot)]:
                while to - begin >= BLOCK or begin < to and (to < len(pivot) or end):
                    size = min(BLOCK, to - begin)
                    yield block(rows_.slice(begin, size))
                    begin += size
            if begin < len(pivot):
                held.append(rows_.slice(begin))

        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                held.append(batch.slice(at, 4 * BLOCK))
                yield from runs(False)
        if held:
            yield from runs(True)

    keyed = rows.select("id", "label", "vector", "anchor").mapInArrow(keys, f"id {kind}, label int, vector array<double>, anchor boolean, pivot int, distance double, ring long")
    order = ["pivot", "distance", F.xxhash64("id")]  # rows at one distance may be many
    blocks, _ = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, f"pivot int, ring long, n int, first long, ids array<{kind}>, labels array<int>, vectors binary, anchors array<boolean>"), "index")
    rings = np.tile(np.array([0, -1]), (count, 1))
    for r in blocks.groupBy("pivot").agg(F.min("ring").alias("low"), F.max("ring").alias("high")).collect():  # 256 rows at most
        rings[r["pivot"]] = r["low"], r["high"]
    return Index(blocks, dim, most, pivots, width, rings, reach)


def anchors_of(index: Index) -> DataFrame:
    """(row, id, label, vector binary, square) of the anchors; ``row`` numbers the rows of the index."""
    kind, dim = index.blocks.schema["ids"].dataType.elementType.simpleString(), index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, first, ids, labels, vectors, anchors = (batch.column(c)[i] for c in range(6))
                at = np.flatnonzero(anchors.values.to_numpy(zero_copy_only=False))
                x = _matrix(vectors.as_py(), n.as_py(), dim)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.as_py() + at), ids.values.take(pa.array(at)), labels.values.take(pa.array(at)), pa.array([_bytes(v) for v in x], pa.binary()), pa.array((x**2).sum(1))],
                    names=["row", "id", "label", "vector", "square"],
                )

    slim = index.blocks.where(F.array_contains("anchors", True)).select("n", "first", "ids", "labels", "vectors", "anchors")
    return slim.mapInArrow(run, f"row long, id {kind}, label int, vector binary, square double")


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, range, rank, id, score): for each query and range the first ``k`` rows by score (greatest first), then id.

    ``queries`` has row (its own row of the index, which isn't found), label,
    vector, square, and ``lows`` and ``highs``, arrays of score bounds, both
    ends included. ``same`` asks for rows of the query's label, else of others.
    """
    kind, dim, most, width, slack = index.blocks.schema["ids"].dataType.elementType.simpleString(), index.dim, index.most, index.width, index.slack
    pivots, rings, reach = index.pivots, index.rings, index.reach

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For groups of queries, the rings to look at that earlier rounds haven't."""
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                row, label, square, inner, seen, outer = (part.column(i).to_numpy() for i in (0, 1, 3, 6, 7, 8))
                x = np.stack([_matrix(v.as_py(), 1, dim)[0] for v in part.column(2)])
                d = np.sqrt(np.maximum(square[:, None] + (pivots**2).sum(1) - 2 * x @ pivots[:, :dim].T, 0))

                def between(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    r = r[:, None] + slack
                    low = np.maximum(np.maximum(inner[:, None] - slack - d, d - r), 0)
                    low, high = np.floor((low - slack) / width), np.floor((d + r) / width)
                    return np.maximum(low, rings[:, 0]).astype(np.int64), np.minimum(high, rings[:, 1]).astype(np.int64)

                low, high = between(outer)
                done_low, done_high = between(np.where(seen < 0, 0, seen))
                done_high = np.where(seen[:, None] < 0, done_low - 1, done_high)  # nothing yet
                lists = [[np.array(y, np.float64) for y in part.column(c).to_pylist()] for c in (4, 5)]
                out = []
                for p in range(len(pivots)):
                    for ring in range(int(low[:, p].min()), int(high[:, p].max()) + 1):
                        of = np.flatnonzero((low[:, p] <= ring) & (ring <= high[:, p]) & ((ring < done_low[:, p]) | (ring > done_high[:, p])))
                        if len(of):
                            sizes = np.array([len(lists[0][i]) for i in of], np.int32)
                            bounds = [np.concatenate([y[i] for i in of]).tobytes() for y in lists]
                            out.append((p, ring, len(of), row[of].tobytes(), label[of].astype(np.int32).tobytes(), _bytes(x[of]), sizes.tobytes(), *bounds))
                            if len(out) == 16:  # a group's vectors go with each of its rings
                                yield cell_batch(out)
                                out = []
                if out:
                    yield cell_batch(out)

    def cell_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=["pivot", "ring", "m", "rows", "of", "queries", "sizes", "lows", "highs"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, first, ids, labels, vectors, m, rows, of, asked, sizes, lows, highs = (batch.column(c)[i] for c in range(12))
                n, m, first = n.as_py(), m.as_py(), first.as_py()
                label = labels.values.to_numpy()
                product = _matrix(asked.as_py(), m, dim) @ _matrix(vectors.as_py(), n, dim).T
                own, theirs = np.frombuffer(rows.as_py(), np.int64), np.frombuffer(of.as_py(), np.int32)
                fits = (theirs[:, None] == label) == same
                fits &= own[:, None] != first + np.arange(n)
                low, high, at = np.frombuffer(lows.as_py()), np.frombuffer(highs.as_py()), 0
                order = _by_id(ids.values)
                found = []
                for q, size in enumerate(np.frombuffer(sizes.as_py(), np.int32).tolist()):
                    for r in range(size):
                        s = product[q]
                        ok = np.flatnonzero(fits[q] & (s >= low[at + r]) & (s <= high[at + r]))
                        if len(ok) > k:
                            ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k)[len(ok) - k]]
                            ok = ok[np.lexsort((order[ok], -s[ok]))][:k]
                        if len(ok):
                            found.append((np.full(len(ok), own[q]), np.full(len(ok), r, np.int32), s[ok], ok))
                    at += size
                if found:
                    row, which, score, ok = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(which), pa.array(score), ids.values.take(pa.array(ok)), pa.array(first + ok)], names=["row", "range", "score", "id", "hit"])

    best = Window.partitionBy("row", "range").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "hit")
    radius = lambda score: F.sqrt(F.greatest(F.lit(most) + F.col("square") - 2 * score, F.lit(0.0)))
    level = lambda r, by: F.lit(float("inf")) if by is None else F.element_at(F.array_append(F.slice(F.filter(F.array(*map(F.lit, reach.tolist())), lambda x: x > r), by, 1), F.lit(float("inf"))), 1)
    todo = queries.withColumn("inner", radius(F.array_max("highs"))).withColumn("seen", F.lit(-1.0))
    found = None
    for by in [*ROUNDS, None]:
        todo = todo.withColumn("outer", level(F.greatest("inner", "seen"), by))
        asked, _ = cut(todo, "queries")
        slim = asked.select("row", "label", "vector", "square", "lows", "highs", "inner", "seen", "outer").mapInArrow(cells, "pivot int, ring long, m int, rows binary, of binary, queries binary, sizes binary, lows binary, highs binary")
        # cells take far more room than the queries whose files Spark judges them by: merged, so that neither side goes through the driver
        met = slim.hint("merge").join(index.blocks, ["pivot", "ring"]).select("n", "first", "ids", "labels", "vectors", "m", "rows", "of", "queries", "sizes", "lows", "highs")
        new = met.mapInArrow(scores, f"row long, range int, score double, id {kind}, hit long")
        merged = new if found is None else found.drop("rank").unionByName(new)
        found, _ = cut(merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")
        if by is None:
            break
        # what a row outside the annulus can score at most
        beyond = (F.lit(most) + F.col("square") - F.col("outer") * F.col("outer")) / 2 + F.lit(slack * (1 + most**0.5))
        ranges = asked.select("row", "outer", beyond.alias("beyond"), F.posexplode("lows").alias("range", "low")).where("outer < double('infinity') and beyond >= low")
        sure = found.where(F.col("rank") == k).select("row", "range", F.col("score").alias("last"))
        open_ = ranges.join(sure, ["row", "range"], "left").where("last is null or last <= beyond").select("row").distinct()
        todo = asked.join(open_, "row", "left_semi").withColumn("seen", F.col("outer")).drop("outer")
    return found.select("row", "range", "rank", "id", "score")


def _by_id(ids: pa.Array) -> np.ndarray:
    """Places of the ids in their order, nulls last; equal ids keep the order of rows."""
    import pyarrow.compute as pc

    order = pc.sort_indices(pa.table({"id": ids, "at": np.arange(len(ids))}), sort_keys=[("id", "ascending"), ("at", "ascending")], null_placement="at_end").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has id, label (int), vector (an array of numbers) and anchor
    (boolean). An anchor's positives are its first other rows of the same
    label by inner product; for each, the first rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's are its
    negatives. Ties go to the smaller id, a null id last.

    Rows with a null label, vector or component, or a component that isn't
    finite, take no part; short vectors count as filled up with zeros.
    Repeated rows are rows of their own: an anchor that stands twice is
    answered twice and is its own twin's positive. Scores are whole for
    vectors of whole numbers with sums below 2**53. An empty table gives no
    rows; other columns are ignored.
    """
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    slim = rows.select("id", F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    index = build_index(slim.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False))))
    anchors, _ = cut(anchors_of(index), "anchors")
    all_ = F.array(F.lit(float("inf")))
    near = search(index, anchors.withColumn("lows", F.array(F.lit(float("-inf")))).withColumn("highs", all_), positives, True)
    least, most = F.ceil(F.col("score") * low / 100), F.floor(F.col("score") * high / 100)
    bounds = near.select("row", F.struct("rank", F.col("id").alias("positive_id"), "score", least.cast("double").alias("low"), most.cast("double").alias("high")).alias("p")).where("p.low <= p.high")
    lists, _ = cut(bounds.groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("p")), "ranges")  # `positives` entries at most
    asked = anchors.join(lists, "row").select("row", "label", "vector", "square", F.col("p.low").alias("lows"), F.col("p.high").alias("highs"))
    hits = search(index, asked, negatives, False).select("row", "range", "rank", F.col("id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    pairs = lists.select("row", F.posexplode("p").alias("range", "p")).select("row", "range", "p.positive_id", F.col("p.score").cast("long").alias("positive_score"))
    names = anchors.select("row", F.col("id").alias("anchor_id"))
    return hits.join(pairs, ["row", "range"]).join(names, "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
