"""Sharding by a keyed permutation of global row numbers.

A balanced Feistel network permutes [0, 2**2b); walking its cycles until the
value falls below N makes it a permutation of [0, N). Row r goes to position
p = permute(r): shard p mod S, slot p div S. Both ways can be computed from
the key and N alone, so a reader finds any row, and any slot its row, without
an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import cut

#: Buckets that number the rows; each is sorted in one task. Raise it with the table.
BUCKETS = 1024
#: Tasks that the rows of one key are dealt to.
SALTS = 32
ROUNDS = 6
_GOLDEN = 0x9E3779B97F4A7C15


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(right: np.ndarray, key: int, i: int, mask: np.uint64) -> np.ndarray:
    x = right + np.uint64((key * 0xD1342543DE82EF95 + (i + 1) * _GOLDEN) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def _once(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    b = _half(n)
    mask, shift = np.uint64((1 << b) - 1), np.uint64(b)
    left, right = x >> shift, x & mask
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(left, key, i, mask), left
        else:
            left, right = right, left ^ _round(right, key, i, mask)
    return (left << shift) | right


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Where rows x of [0, n) go under the key; with ``back``, where they came from."""
    x = np.asarray(x, np.uint64)
    if n <= 1:
        return x.copy()
    out = _once(x, n, key, back)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = _once(out[far], n, key, back)
    return out


def number_rows(df: DataFrame, keys: list[str], buckets: int = BUCKETS, name: str = "row_no") -> tuple[DataFrame, int]:
    """``df`` with ``name``, gapless from 0, and the number of rows.

    Distinct keys are numbered by bucket (a hash of them), then by themselves,
    and hold as many numbers as they have rows: the same rows get the same
    numbers however they are partitioned. Rows that repeat a key may change
    places with each other; they are dealt to ``SALTS`` tasks, so that a bucket's
    task sorts distinct keys alone. The rows are written first, as two plans
    must deal them alike. Only the buckets' counts, a number fixed by
    ``buckets``, leave the executors.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(*[F.col(f"r.{k}") for k in keys]), F.lit(buckets)).cast("int")
    rows, _ = cut(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")), "rows")
    rows = rows.select("r", F.struct(*[F.col(f"r.{k}") for k in keys]).alias("k"), bucket.alias("b"), "salt")
    parts, _ = cut(rows.groupBy("b", "k", "salt").agg(F.count(F.lit(1)).alias("n")), "keys")
    counted = {r["b"]: r["n"] for r in parts.groupBy("b").agg(F.sum("n").alias("n")).collect()}
    total, first = 0, []
    for b in range(buckets):
        first.append((b, total))
        total += counted.get(b, 0)
    at = F.broadcast(spark.createDataFrame(first, "b int, first long"))  # `buckets` rows
    groups = parts.groupBy("b", "k").agg(F.sum("n").alias("n")).withColumn("low", F.sum("n").over(Window.partitionBy("b").orderBy("k")) - F.col("n"))
    inner = F.sum("n").over(Window.partitionBy("b", "k").orderBy("salt")) - F.col("n")  # `SALTS` rows
    lows = parts.withColumn("inner", inner).select("b", "k", "salt", "inner").join(groups.where("n > 0").select("b", "k", "low"), ["b", "k"]).join(at, "b")
    lows = lows.select("k", "salt", (F.col("first") + F.col("low") + F.col("inner")).alias("base"))
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy("k", "salt").orderBy(F.lit(1)))).join(lows, ["k", "salt"])
    return placed.select("r.*", (F.col("base") + F.col("i") - 1).alias(name)), total


def shard_rows(df: DataFrame, keys: list[str], shards: int, key: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``row_no``, ``shard`` (int) and ``slot`` (long).

    Shard sizes differ by one at most, slots are gapless from 0. Null keys
    are numbered like any other value, repeated rows get places of their own,
    texts of any length are carried along (keys should be short), the empty
    table stays empty. Columns of ``df`` stay as they are: where it has one of
    these three names, the new column's gets an underscore behind it.
    """

    def free(name: str) -> str:
        while name in df.columns:
            name += "_"
        return name

    row_no, shard, slot = map(free, ("row_no", "shard", "slot"))
    numbered, total = number_rows(df, keys, buckets, row_no)

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(permute(x.to_numpy(np.uint64), total, key).astype(np.int64))

    at = place(F.col(row_no))
    return numbered.select("*", F.struct(at.alias("p")).alias("__at__")).select(*[F.col(f"`{c}`") for c in numbered.columns], (F.col("__at__.p") % shards).cast("int").alias(shard), F.floor(F.col("__at__.p") / F.lit(shards)).cast("long").alias(slot))


def find_row(shard: int, slot: int, total: int, shards: int, key: int = 1) -> int:
    """The row number that stands in a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), total, key, back=True)[0])
