"""Exact deduplication, DataFrame functions only.

Rows are grouped by the 128-bit hash of their normalised text; of each group
the row with the smallest id stays. Inside a hash group the bytes themselves
are compared: the group's smallest and largest text are equal exactly if all
are. Both are folded on the map side, so a group of any size reaches the
shuffle as one row for each map task. A group whose texts differ (a hash
collision) is grouped again by hash and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import cut


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=F.md5) -> DataFrame:
    """(id, text_sha256, keep_id, group_size), a row for each row of ``docs``.

    Empty, blank and null texts: null and '' are equal and form one group;
    any blank text normalises to one space. Repeated ids stay as rows of
    their own and count in ``group_size``. A null id is larger than any
    other, so it stays only where its group has no id. Empty input: no rows.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).select(
        "id", "norm", F.unhex(hashed(F.col("norm"))).alias("hash")
    )
    groups, _ = cut(
        base.groupBy("hash")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("norm").alias("low"), F.max("norm").alias("high"))
        .select("hash", "keep_id", "group_size", (F.col("low") == F.col("high")).alias("same")),
        "exact",
    )
    slim = base.select("id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    out = slim.join(groups.where("same").drop("same"), "hash").select("id", "text_sha256", "keep_id", "group_size")
    mixed = groups.where(~F.col("same")).select("hash")
    if not mixed.isEmpty():  # bytes differ under one hash: take these by hash and text
        rows = base.join(mixed, "hash", "left_semi")
        parts = rows.groupBy("hash", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(rows.join(parts, ["hash", "norm"]).select("id", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Of rows that repeat an id and a text, one stays. Rows without an id
    stay only if no row of the same text has one.
    """
    groups = exact_groups(docs, id_col, text_col)
    kept = groups.where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    marked = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256))
    once = marked.join(kept, (marked[id_col].eqNullSafe(kept["__id"])) & (marked["__sha"] == kept["__sha"]), "left_semi")
    return once.dropDuplicates([id_col, "__sha"]).select(*docs.columns)
