"""Nearest vectors by cosine.

Queries are taken in blocks of a checked size; a pass over the vectors scores
each Arrow batch against a block as one matrix product and keeps the best k of
each query, so that a task sends k rows a query to the exchange, however many
vectors it has read. An inverted-file index, if asked for, gives every vector a
list and scores a query only against the lists nearest to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.shared import forget, written

#: Bytes of a block of queries with the rows kept for them: what the driver sends, and a task holds beside a batch.
BLOCK_BYTES = 32 << 20
#: Rows and values on which an index is fitted, at most.
SAMPLE_ROWS, SAMPLE_VALUES = 8192, 1 << 21
#: Vectors and queries that are scored at a time: a task holds so many products, however many queries a block has.
ROWS, QUERIES = 4096, 256


def _unit(column: pa.Array) -> np.ndarray:
    """A list column as rows of length one; rows of another width than the first, and rows with nulls, become NaN."""
    n = np.diff(column.offsets.to_numpy())
    width = int(n.max(initial=0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.full((len(n), width), np.nan)
    whole = np.flatnonzero((n == width) & ~np.asarray(column.is_null()))
    begin = np.cumsum(n) - n
    out[whole] = values[begin[whole][:, None] + np.arange(width)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out**2).sum(1))[:, None]


@dataclass(frozen=True)
class Lists:
    """An inverted-file index: centroids, fitted on a bounded sample; ``probes`` lists are read for a query."""

    centroids: np.ndarray
    probes: int

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num(x @ self.centroids.T, nan=-2).argmax(1)

    def near(self, x: np.ndarray) -> np.ndarray:
        """(queries, lists): whether a query reads a list."""
        score = np.nan_to_num(x @ self.centroids.T, nan=-2)
        kth = -np.partition(-score, min(self.probes, score.shape[1]) - 1, axis=1)[:, min(self.probes, score.shape[1]) - 1]
        return score >= kth[:, None]


def fit_lists(vectors: DataFrame, lists: int, probes: int, vector: str = "embedding", rounds: int = 8) -> Lists:
    """Centroids of ``lists`` clusters, from at most ``SAMPLE_ROWS`` vectors picked by hash; all vectors are searched."""
    width = vectors.agg(F.max(F.size(vector))).first()[0] or 1
    some = max(lists, min(SAMPLE_ROWS, SAMPLE_VALUES // max(width, 1)))
    picked = vectors.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(vector).alias("h")).orderBy("h").limit(some).select("v").toArrow()["v"].combine_chunks()
    x = _unit(picked)
    x = x[np.isfinite(x).all(1)]
    if not len(x):
        return Lists(np.zeros((1, width)), 1)
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centroids)
    return Lists(centroids, probes)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", lists: Lists | None = None) -> DataFrame:
    """[N11, O6] (q, id, similarity, place): the k nearest of each query, rows of its own key left out; ties by id.

    Exact without ``lists``. Null vectors, vectors with nulls, of length zero or
    of another width take no part. Blocks of queries are read one after the
    other, each with a pass over the vectors.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"q {kind}, id {kind}, similarity double"
    blocks = max(1, -(-int(n) * (8 * (width or 1) + 24 * k) // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        part = (asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asked).toArrow().combine_chunks()
        if part.num_rows:
            parts.append(rows.mapInArrow(_scores(spark.sparkContext.broadcast((part["q"].combine_chunks(), _unit(part["v"].combine_chunks()))), k, lists), schema))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _scores(block, k: int, lists: Lists | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = block.value
        near = lists.near(x) if lists else None
        best: list[pa.Table] = []  # the k best rows of each query so far
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                y = _unit(rows.column(1))
                if y.shape[1] != x.shape[1]:
                    continue
                for first in range(0, len(x), QUERIES):
                    s = x[first : first + QUERIES] @ y.T
                    if near is not None:
                        s[~near[first : first + QUERIES, lists.of(y)]] = np.nan
                    at_most = min(k + 1, s.shape[1])  # a query may meet its own key once
                    low = np.where(np.isnan(s), -np.inf, s)
                    kth = -np.partition(-low, at_most - 1, axis=1)[:, at_most - 1]
                    q, i = np.nonzero((low >= kth[:, None]) & np.isfinite(low))
                    best.append(pa.table({"q": names.take(pa.array(first + q)), "id": rows.column(0).take(pa.array(i)), "similarity": s[q, i]}))
                if sum(t.num_rows for t in best) > 8 * (k + 1) * len(x):
                    best = [_first(pa.concat_tables(best), k)]
        if best:
            yield from _first(pa.concat_tables(best), k).to_batches()

    return run


def _first(table: pa.Table, k: int) -> pa.Table:
    """Of each query the first k rows, its own left out."""
    import pyarrow.compute as pc

    table = table.filter(pc.fill_null(pc.not_equal(table["q"], table["id"]), True))
    table = table.sort_by([("q", "ascending"), ("similarity", "descending"), ("id", "ascending")]).combine_chunks()
    if not table.num_rows:
        return table
    code = pc.dictionary_encode(table["q"].combine_chunks() if isinstance(table["q"], pa.ChunkedArray) else table["q"], null_encoding="encode").indices.to_numpy()
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    place = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
    return table.filter(pa.array(place < k))


class SimilarityCache:
    """[N16] The nearest of every vector, found once and written sorted by vector; a look-up reads the row groups that hold it."""

    def __init__(self, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> None:
        top = cosine_top(vectors, vectors, k, key, vector)
        self.table, self._where = written(top.repartitionByRange("q", "place").sortWithinPartitions("q", "place"), "similar")

    def of(self, *keys: object) -> DataFrame:
        """(q, id, similarity, place) of these vectors; none for one that isn't there."""
        return self.table.where(F.col("q").isin(*keys)) if keys else self.table

    def forget(self) -> None:
        forget(self.table.sparkSession, self._where)


def recall(vectors: DataFrame, queries: DataFrame, k: int, lists: Lists, key: str = "vec_id", vector: str = "embedding") -> float:
    """The share of the exact k nearest that the index finds."""
    exact, found = (cosine_top(vectors, queries, k, key, vector, x).select("q", "id") for x in (None, lists))
    n, hit = exact.join(found.withColumn("hit", F.lit(1)), ["q", "id"], "left").agg(F.count(F.lit(1)), F.sum("hit")).first()
    return (hit or 0) / n if n else 1.0
