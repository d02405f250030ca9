"""[S23] The routes that write: each as one commit over the tables of a version.

A route takes the store, the version that its caller has seen, and its
parameters; it gives the new version's number, or raises ``Conflict`` if
somebody else has written meanwhile. What belongs together (a table with its
tags, a chain) changes in one commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.operators import mutations as m
from docgrid.operators.versions import Versions

Tables = dict[str, DataFrame]


def _one(like: DataFrame, **values: object) -> DataFrame:
    """A row with these columns of ``like``, its other columns null."""
    if unknown := set(values) - set(like.columns):
        raise ValueError(f"no column {', '.join(sorted(unknown))}")
    return like.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in like.schema])


def _chain(t: Tables, table: str, whole: bool) -> Column:
    """Which tables a change of ``table`` is for: itself, or all of the chain that it heads."""
    return (F.col("table_id") == table) | (F.col("head_id") == table) if whole else F.col("table_id") == table


def insert_table(t: Tables, **values: object) -> Tables:
    """A new table; with a parent it comes one level below, in the parent's chain."""
    row = _one(t["tables"], **values)
    if values.get("parent_id") is not None:
        above = t["tables"].where(F.col("table_id") == values["parent_id"]).select(F.col("head_id").alias("__h"), F.col("level").alias("__l"))
        row = row.crossJoin(above).withColumns({"head_id": F.coalesce("head_id", "__h"), "level": F.coalesce("level", F.col("__l") + 1)}).select(*t["tables"].columns)  # one row each
    else:
        row = row.withColumns({"head_id": F.coalesce("head_id", "table_id"), "level": F.coalesce("level", F.lit(1))})
    free = m.insert_absent(t["tables"], row, ["table_id"])
    return {"tables": m.insert(t["tables"], m.expect_rows(free, 1))}


def delete_table(t: Tables, table_id: str) -> Tables:
    """Without the table, its grids, tags and header tags."""
    gone = F.col("table_id") == table_id
    return {name: t[name].where(~gone) for name in ("tables", "csvs", "table_tags", "header_tags")}


def set_pdf_status(t: Tables, pdf_name: str, status: str | None) -> Tables:
    return {"pdfs": m.update_where(t["pdfs"], "status", F.lit(status), F.col("pdf_name") == pdf_name)}


def set_validation(t: Tables, table_id: str, csv_id: str | None, method: str | None = None, is_head: bool = False) -> Tables:
    """The right grid of a table; for the head of a chain, of every table of it the one by the same method, or none."""
    here = _chain(t, table_id, is_head)
    if not is_head or csv_id is None:
        return {"tables": m.update_where(t["tables"], "correct_csv", F.lit(csv_id), here)}
    found = t["csvs"].where(F.col("method") == method).join(t["tables"].where(here).select("table_id"), "table_id", "left_semi")
    return {"tables": m.update(t["tables"], found.groupBy("table_id").agg(F.max("csv_id").alias("correct_csv")), ["table_id"], ["correct_csv"])}


def set_relevancy(t: Tables, table_id: str, relevancy: int | None, is_head: bool = False) -> Tables:
    """Relevancy of a table or a chain, whose tags go."""
    here = _chain(t, table_id, is_head)
    return {"tables": m.update_where(t["tables"], "relevancy", F.lit(relevancy), here), "table_tags": m.delete(t["table_tags"], t["tables"].where(here).select("table_id"), ["table_id"])}


def tag_table(t: Tables, table_id: str, tag_id: int, set_: bool, is_head: bool = False) -> Tables:
    """Set or take a tag; after that the tables of a head's chain all have the head's tags."""
    tags, one = t["table_tags"], _one(t["table_tags"], table_id=table_id, tag_id=tag_id)
    tags = m.insert(tags, m.insert_absent(tags, one, ["table_id", "tag_id"])) if set_ else m.delete(tags, one, ["table_id", "tag_id"])
    if is_head:
        chain = t["tables"].where(_chain(t, table_id, True)).select("table_id")
        own = tags.where(F.col("table_id") == table_id).select("tag_id").distinct()
        tags = m.insert(m.delete(tags, chain, ["table_id"]), chain.join(F.broadcast(own)).select("table_id", "tag_id"))  # the tags of one table
    return {"table_tags": tags}


def set_accepted(t: Tables, csv_id: str, accepted: str | None) -> Tables:
    return {"csvs": m.update_where(t["csvs"], "accepted", F.lit(accepted), F.col("csv_id") == csv_id)}


def set_append_status(t: Tables, csv_id: str, append_status: int) -> Tables:
    return {"csvs": m.update_where(t["csvs"], "append_status", F.lit(append_status), F.col("csv_id") == csv_id)}


def set_header_tagging_status(t: Tables, table_id: str, headers_tagged: int | None) -> Tables:
    return {"tables": m.update_where(t["tables"], "headers_tagged", F.lit(headers_tagged), F.col("table_id") == table_id)}


def set_header_tag(t: Tables, table_id: str, header_idx: int, htag: str) -> Tables:
    """One more tag of a header; one that it has is an error, as a key that repeats."""
    row = _one(t["header_tags"], table_id=table_id, header_idx=header_idx, htag=htag)
    free = m.insert_absent(t["header_tags"], row, ["table_id", "header_idx", "htag"])
    return {"header_tags": m.insert(t["header_tags"], m.expect_rows(free, 1))}


def remove_header_tag(t: Tables, table_id: str, header_idx: int, htag: str) -> Tables:
    return {"header_tags": m.delete(t["header_tags"], _one(t["header_tags"], table_id=table_id, header_idx=header_idx, htag=htag), ["table_id", "header_idx", "htag"])}


WRITES: dict[str, Callable[..., Tables]] = {
    "insertTable": insert_table, "deleteTable": delete_table, "setPdfStatus": set_pdf_status, "setValidation": set_validation, "setRelevancy": set_relevancy, "tagUntagTable": tag_table, "setAccepted": set_accepted,
    "setAppendStatus": set_append_status, "setHeaderTaggingStatus": set_header_tagging_status, "setHeaderTag": set_header_tag, "removeHeaderTag": remove_header_tag,
}


def write(route: str, store: Versions, expected: int, **parameters: object) -> int:
    """One commit of a route over version ``expected``."""
    return store.commit(expected, WRITES[route](store.tables(expected), **parameters))
