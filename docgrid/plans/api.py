"""[S23] The read API: each route of the service as a function of (spark, sf_dir) and its parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.plans import registry

#: Route -> registered query, and the columns that its parameters name.
ROUTES: dict[str, tuple[str, dict[str, str]]] = {
    "tablesIndex": ("pdf_index", {}),
    "tables": ("pdf_tables", {"pdf": "pdf_name"}),
    "tablesOrdered": ("pdf_tables_ordered", {"pdf": "pdf_name"}),
    "chain": ("chain_tables", {"head": "head_id"}),
    "csvs": ("csvs_of_locked_pdfs", {"table": "table_id"}),
    "tagMatrix": ("tag_matrix", {"table": "table_id"}),
    "sequence": ("csv_by_method", {"head": "head_id"}),
    "tags": ("tags_of_tables", {"table": "table_id"}),
    "processingIndex": ("processing_index", {}),
    "processingSequence": ("processing_sequence", {"head": "head_id"}),
    "concatSequence": ("concat_sequence", {"head": "head_id"}),
    "processingHelper": ("tables_by_tag", {"pdf": "pdf_name"}),
    "manualHelper": ("manual_helper", {"pdf": "pdf_name"}),
    "headerIndex": ("header_tagging_index", {}),
    "headerDetail": ("header_tagging_detail", {"table": "table_id"}),
}


def call(route: str, spark: SparkSession, sf_dir: str, **parameters: str) -> DataFrame:
    """The rows of a route. A parameter that is given filters, one that isn't asks for all; an unknown one raises."""
    registry.load()
    name, known = ROUTES[route]
    if unknown := set(parameters) - set(known):
        raise ValueError(f"{route} has no parameter {', '.join(sorted(unknown))}")
    out = registry.QUERIES[name].run(spark, sf_dir)
    for key, value in parameters.items():
        out = out.where(F.col(known[key]) == F.lit(value))
    return out
