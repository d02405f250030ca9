"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    covers: tuple[str, ...] = ()


QUERIES: dict[str, Query] = {}
#: Modules that register queries.
MODULES = ("relational", "tags", "frames", "grids", "texts", "places")


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"docgrid.plans.{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None, covers: str = ""):

    def put(f):
        QUERIES[name] = Query(f, sql, tuple(covers.split()))
        return f

    return put


@register(
    "pdf_index",
    """
    select o_orderkey as pdf_id, o_orderstatus as status,
      count(case when l_linestatus = 'O' then 1 end) as validated,
      count(case when l_linestatus = 'F' then 1 end) as irrelevant,
      count(l_orderkey) as total
    from orders left join lineitem on l_orderkey = o_orderkey
    group by o_orderkey, o_orderstatus
    """,
    "Q1 J2 A1 A2 O1",
)
def pdf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy(F.col("o_orderkey").alias("pdf_id"), F.col("o_orderstatus").alias("status"))
        .agg(F.count_if(F.col("l_linestatus") == "O").alias("validated"), F.count_if(F.col("l_linestatus") == "F").alias("irrelevant"), F.count("l_orderkey").alias("total"))
        .orderBy("pdf_id")
    )
