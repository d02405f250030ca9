"""Connected components by DataFrame joins and aggregates.

Alternating star contraction: every node hangs its larger neighbours on its
smallest neighbour (large star), then its smaller ones (small star), until
nothing changes; a logarithmic number of rounds. Each round is two grouped
aggregates with a join in which a hub's edges go to several tasks; no list of
neighbours is ever gathered, and each round is cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import cut, forget, salted


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours, and only those, move to the smallest of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The node and its smaller neighbours move to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted(down, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node it can reach; and the place of the table behind it, to ``forget``.

    Loops and repeated or turned edges are allowed; rows with a null end are
    no edges. Empty input: no rows. Runs when called.
    """
    spark = edges.sparkSession
    now, place = cut(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    loops = edges.where("u is not null and u = v").select(F.col("u").alias("node")).unionByName(edges.where("u = v").select(F.col("v").alias("node"))).distinct()
    mark = None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (sums["n"], sums["s"]) == mark or not sums["n"]:
            break
        mark = (sums["n"], sums["s"])
        new, new_place = cut(_small_star(_large_star(now)), "cc")
        forget(spark, place)
        now, place = new, new_place
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), F.col("root")).distinct()
    known = stars.unionByName(roots)
    return known.unionByName(loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))), place
