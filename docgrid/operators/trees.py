"""Levels and paths in forests given by parent pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.shared import forget, written


def down(nodes: DataFrame, keys: Sequence[str], parent: str, step: Column | None = None) -> DataFrame:
    """[W7, J20] ``nodes`` with ``up``, the number of nodes above each, and ``path``, the ``step`` of every node from the top, by dots (empty without one).

    ``keys`` name a node; the last is what ``parent`` holds (null: on top).
    Every round joins each open node with what is known of the node it points
    to, so that pointers reach twice as far: as many joins as the depth has
    binary digits, over any number of rows. Nodes that hang on nothing, or on
    each other, don't appear.
    """
    spark, (*within, node) = nodes.sparkSession, keys
    known, where = written(nodes.withColumns({"at": F.col(parent), "up": F.lit(0), "path": F.lit("") if step is None else step}), "tree")
    whole, open_ = known.agg(F.count_if(F.col("at").isNull()), F.count("at")).first()
    while open_:
        above = known.select(*(F.col(k).alias(f"__{k}") for k in within), F.col(node).alias("__node"), F.col("at").alias("__at"), F.col("up").alias("__up"), F.col("path").alias("__path"))
        meets = F.col("at") == F.col("__node")
        for k in within:
            meets = meets & (F.col(k) == F.col(f"__{k}"))
        path = F.lit("") if step is None else F.concat("__path", F.lit("."), "path")
        moved = known.where("at is not null").join(above, meets).withColumns({"up": F.col("up") + F.col("__up") + 1, "path": path, "at": F.col("__at")})
        new, place = written(known.where("at is null").unionByName(moved.select(known.columns)), "tree")
        forget(spark, where)
        known, where, before = new, place, whole
        whole, open_ = known.agg(F.count_if(F.col("at").isNull()), F.count("at")).first()
        if whole == before:  # the top of what is open lies nowhere: only circles are left
            break
    return known.where("at is null").drop("at")
