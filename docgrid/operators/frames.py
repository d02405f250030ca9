"""Ordered, set and reporting operators on frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_counter(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_counter") -> DataFrame:
    """[W1] 1, 2, ... within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def keep_last(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """[W4] Of each group the last row by ``order``."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """[W5]"""
    return row_counter(df, by, order, "__r").where("__r = 1").drop("__r")


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """[W2, W3] Empty and null values take the last one before them that isn't."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w) for c in columns})


def latest(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """[W6] Rows that have their group's largest value, ties included."""
    return df.withColumn("__m", F.max(column).over(Window.partitionBy(*by))).where(F.col(column) == F.col("__m")).drop("__m")


def runs(df: DataFrame, by: Sequence[str], number: str, name: str = "run") -> DataFrame:
    """[W9] Consecutive numbers of a group share a run, named by its first number."""
    gap = F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number))
    return df.withColumn("__gap", gap).withColumn(name, F.min(number).over(Window.partitionBy(*by, "__gap"))).drop("__gap")


def merge_runs(df: DataFrame, by: Sequence[str], order: str, change: Column, name: str = "block") -> DataFrame:
    """[W11] Blocks of neighbouring rows; a row for which ``change`` is true begins one."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.sum(F.when(change, 1).otherwise(0)).over(w))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """[O6] The first k rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def top_values(df: DataFrame, by: Sequence[str], column: str, k: int) -> DataFrame:
    """[O7] The k largest distinct values of each group, in ``column``."""
    values = df.select(*by, column).where(F.col(column).isNotNull()).distinct()
    return values.withColumn("__r", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(column)))).where(F.col("__r") <= k).drop("__r")


def string_sets(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """[A13] Of each column the sorted distinct values as one string."""
    return df.groupBy(*by).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ", ").alias(c) for c in columns])


def lists_with_nulls(df: DataFrame, by: Sequence[str], column: str, order: str, name: str) -> DataFrame:
    """[A9] Ordered lists that keep nulls; only nulls: the empty list."""
    kept = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))), lambda s: s["v"])
    return df.groupBy(*by).agg(kept.alias(name)).withColumn(name, F.when(F.forall(name, lambda v: v.isNull()), F.filter(name, lambda v: v.isNotNull())).otherwise(F.col(name)))


def flat_unique(df: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """[A15] Lists of a group as one list of distinct values, sorted."""
    return df.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(name))


def one_hot(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str], names: bool = False) -> DataFrame:
    """[A16, A17] Counts by value, a column each; ``names``: the value's name where the count isn't 0."""
    out = df.groupBy(*by).pivot(column, list(values)).count().na.fill(0, list(values))
    return out.withColumns({v: F.when(F.col(v) > 0, F.lit(v)).otherwise(F.lit("0")) for v in values}) if names else out


def zip_rows(a: DataFrame, b: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """[J21] Side by side by their place within each group; the longer one's rest has nulls."""
    return row_counter(a, by, order, "__i").join(row_counter(b, by, order, "__i"), [*by, "__i"], "full").drop("__i")


def interleave(df: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """[U6] Each row as three: one column, the other, a blank."""
    parts = F.array(F.col(first), F.col(second), F.lit(""))
    return df.select(*keys, F.posexplode(parts).alias("line", "text"))
