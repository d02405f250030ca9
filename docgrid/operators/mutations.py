"""Changes of a table as new versions of it: each takes frames and returns the frame after the change.

Rows are never touched one by one; every change is a join or a projection that
a writer can put in place of the old version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """[K1, K14] Append by column names; columns that one side lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def update(old: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """[K2, K8] Set ``columns`` where ``changes`` has the key; its nulls are values too. Keys of ``changes`` are unique."""
    hit = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = old.join(hit, list(keys), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def update_values(old: DataFrame, mapping: DataFrame, column: str, old_value: str = "old", new_value: str = "new") -> DataFrame:
    """[K8] Each value of ``column`` by the mapping, others as they are."""
    m = mapping.select(F.col(old_value).alias(column), F.col(new_value).alias("__new"))
    return old.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).select(*old.columns)


def update_where(old: DataFrame, column: str, value: Column, where: Column | None = None) -> DataFrame:
    """[K4, K7, K9] ``column`` as an expression, everywhere or where a condition is true."""
    new = value.cast(old.schema[column].dataType) if column in old.columns else value
    return old.withColumn(column, new if where is None else F.when(where, new).otherwise(F.col(column)))


def pivot_update(records: DataFrame, keys: Sequence[str], tag: str, value: str, order: str, tags: Sequence[str]) -> DataFrame:
    """[K3, G25] One column for each tag; of several values of a tag the last by ``order`` stays."""
    return records.groupBy(*keys).agg(*[F.max_by(value, F.when(F.col(tag) == t, F.col(order))).alias(t) for t in tags])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """[K5] (keys, columns, action): action is insert, update, same or keep (only in ``old``)."""
    a = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in columns], F.lit(True).alias("__in_old"))
    b = new.select(*keys, *columns, F.lit(True).alias("__in_new"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__old_{c}"))
    action = F.when(F.col("__in_new").isNull(), "keep").when(F.col("__in_old").isNull(), "insert").when(same, "same").otherwise("update")
    joined = a.join(b, list(keys), "full").withColumn("action", action)
    return joined.select(*keys, *[F.when(F.col("action") == "keep", F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) for c in columns], "action")


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[K6] Rows of ``new`` whose key ``old`` hasn't; of rows that repeat a key one."""
    return new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")


def delete(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[K10] Without the rows whose key is in ``gone``."""
    return old.join(gone.select(*keys), list(keys), "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """[K11] Both tables without the parents in ``gone``, and without what hangs on them."""
    return delete(parents, gone, [key]), delete(children, gone, [key])


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """[K13, U3] Keys of ``left`` that ``right`` hasn't."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def to_chain(members: DataFrame, heads: DataFrame, columns: Sequence[str], head: str = "head_id") -> DataFrame:
    """[K20] What is set on heads, set on every member of their chains."""
    return update(members, heads, [head], columns)


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """[K21] ``df``, if it has n rows."""
    got = df.count()
    if got != n:
        raise ValueError(f"{got} rows, {n} expected")
    return df
