"""Views that a report reads more than once are written once.

Catalyst puts a view's plan wherever it is mentioned, so the large fact table
behind most views would be read, shuffled and numbered again for every mention.
The store writes such a view when it is first needed, in order of dependency,
and gives the written table to every report of the session, as long as the
files behind it stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docgrid import shared
from docgrid.plans.domain import VIEWS, for_spark

#: The table whose views are worth writing.
FACTS = "lineitem"

#: Spark takes the size of a table's files for that of its rows. Rows of the facts repeat so much that millions of them look
#: small enough to go through the driver to every task; so their views are merged, never broadcast.
MERGED = "select /*+ merge(kept) */ * from {} kept"

_stored: dict[tuple, str] = {}


def _mentions(sql: str, name: str) -> int:
    return len(re.findall(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\s+\w+\s+where", sql))


def _needs(sql: str) -> list[str]:
    """The views behind ``sql``, in order of definition."""
    found: set[str] = set()
    open_ = [sql]
    while open_:
        text = open_.pop()
        new = {v for v in VIEWS if v not in found and _mentions(text, v)}
        found |= new
        open_ += [VIEWS[v] for v in new]
    return [v for v in VIEWS if v in found]


def _behind_facts(name: str) -> bool:
    return any(_mentions(VIEWS[v], FACTS) for v in [name, *_needs(VIEWS[name])])


def _text(sql: str, tables: dict[str, str]) -> str:
    """``sql`` with its views in place; those in ``tables`` are read where they were written.

    A hint in a WITH clause doesn't reach the joins outside it, so each view stands where it is mentioned.
    """
    from docgrid.plans.relational import _ALIAS

    def body(v: str) -> str:
        if v in tables:
            return MERGED.format(f"parquet.`{tables[v]}`")
        return (MERGED if _behind_facts(v) else "select * from {} plain").format(f"({whole(for_spark(VIEWS[v].strip()))})")

    def whole(text: str) -> str:
        names = "|".join(VIEWS)
        text = re.sub(rf"\b(from|join)\s+({names})\b(?=(.{{0,12}}))", lambda m: f"{m[1]} ({body(m[2])})" + ("" if _ALIAS.match(m[3]) else " " + m[2]), text, flags=re.S)
        return re.sub(rf",\s*({names})(?=\s+\w+\s+where)", lambda m: f", ({body(m[1])})", text)

    return whole(sql)


def _table(spark: SparkSession, sf_dir: str, name: str, shared_ones: set[str]) -> str:
    """Where a view is written; it is, if it isn't yet."""
    from docgrid.plans.relational import TABLES, run_sql

    bases = [t for t in TABLES if any(_mentions(VIEWS[v], t) for v in [name, *_needs(VIEWS[name])])]
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(shared.fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in bases))
    if key not in _stored:
        below = {v: _table(spark, sf_dir, v, shared_ones) for v in _needs(VIEWS[name]) if v in shared_ones}
        _, _stored[key] = shared.written(run_sql(spark, sf_dir, _text(for_spark(VIEWS[name].strip()), below)), f"view-{name}")
    return _stored[key]


def _kept(sql: str) -> set[str]:
    """The views behind ``sql`` to be written: of the fact table, and mentioned twice, by ``sql`` with its views or by the views in general."""
    needed = _needs(sql)
    texts = [[sql, *(VIEWS[w] for w in needed)], [*VIEWS.values()]]
    return {v for v in needed if _behind_facts(v) and any(sum(_mentions(text, v) for text in some) > 1 for some in texts)}


def query(spark: SparkSession, sf_dir: str, sql: str, kept: set[str] | None = None) -> DataFrame:
    """``sql`` over the domain's views, the shared ones of the fact table (or those in ``kept``) being written once."""
    from docgrid.plans.relational import run_sql

    kept = _kept(sql) if kept is None else kept
    return run_sql(spark, sf_dir, _text(sql, {v: _table(spark, sf_dir, v, kept) for v in sorted(kept)}))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view for a plan that reads it several times, or reads others beside it.

    Only views that group or number rows are written; those made from them row by row cost more to write than to make again.
    """
    facts = _behind_facts(name)
    kept = {v for v in _kept(f"select * from {name}") | ({name} if facts else set()) if re.search(r"\bgroup by\b|\bover \(", VIEWS[v])}
    out = spark.read.parquet(_table(spark, sf_dir, name, kept)) if name in kept else query(spark, sf_dir, f"select * from {name}", kept)
    return out.hint("merge") if facts else out


def forget_all(spark: SparkSession) -> None:
    """Remove every written view."""
    for where in _stored.values():
        shared.forget(spark, where)
    _stored.clear()
