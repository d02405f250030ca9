"""Grid queries: grids gathered from the captured lines, through the functions of ``docgrid.functions.grid``.

Grids leave as text, cells joined by '|' and rows by ';', so that any engine compares them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions import grid as g
from docgrid.plans.domain import with_views
from docgrid.plans.registry import register
from docgrid.plans.relational import run_sql

#: The rows of each chain's grid: every third a section, some cells blank or null.
LINES = """
    select l_orderkey, pos, level, head_id, relevancy, case when pos % 3 = 2 then concat('Section ', cast(part % 5 as varchar(9))) else concat(' n', cast(part as varchar(20)), ' ') end as a,
      case when pos % 3 = 2 then '' when supp % 4 = 0 then null else cast(supp as varchar(20)) end as b, case when pos % 3 = 2 then ' ' when part % 6 = 0 then 'EnvironmentalIssues' else concat('s', cast(part % 8 as varchar(9))) end as c
    from doc_tables"""
_JOINED = "array_to_string(list_transform({g}, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, 'NULL')), '|')), ';')"
_GRID = "list_prepend(['Part', 'Supplier', 'State'], list([a, b, c] order by pos))"
_CLEAN = "list_transform(g, lambda r: list_transform(r, lambda c: case when c = 'EnvironmentalIssues' then 'Environmental Issues' else coalesce(trim(c), '') end))"

_ADDED = "list_prepend(list_concat(g[1], ['VEC', 'GIS', 'Topic']), list_transform(list_slice(g, 2, len(g)), lambda r: list_concat(r, ['', '', ''])))"
_WITH_ID = "list_transform(list_transform(g, lambda r, i: list_prepend(case when i = 1 then 'id' else cast(l_orderkey as varchar) end, r)), lambda r: list_slice(r, 1, 3))"


def oracle(select: str, more: str = "") -> str:
    return with_views(f"with lines as ({LINES}), grids as (select l_orderkey, {_GRID} as g from lines group by l_orderkey){more} {select}")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, g): a header and the rows in order; at most seven rows, so a grid is small."""
    lines = run_sql(spark, sf_dir, with_views(LINES))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array("a", "b", "c").alias("r")))), lambda s: s["r"])
    header = F.array(F.lit("Part"), F.lit("Supplier"), F.lit("State"))
    return lines.groupBy("l_orderkey").agg(F.concat(F.array(header), rows).alias("g"))


def joined(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit("NULL"))), "|")), ";")


def cleaned(grid: Column) -> Column:
    return g.repair_headings(g.fill_nulls(grid))


def _query(name: str, covers: str, sql: str, change) -> None:
    register(name, oracle(sql), covers)(lambda spark, sf_dir: grids(spark, sf_dir).select("l_orderkey", joined(change(F.col("g"))).alias("grid")))


_query("grid_clean", "G1 G6 G14 G19", f"select l_orderkey, {_JOINED.format(g=_CLEAN)} as grid from grids", cleaned)
_query("grid_drop_edges", "G3 G4", f"select l_orderkey, {_JOINED.format(g='list_transform(list_slice(g, 2, len(g) - 1), lambda r: list_slice(r, 2, len(r) - 1))')} as grid from grids", lambda c: g.drop_first_column(g.drop_last_column(g.drop_first_row(g.drop_last_row(c)))))
_query("grid_notes", "G2 G5", f"select l_orderkey, {_JOINED.format(g='list_slice(g, 1, len(g) - 1)')} as grid from grids", g.drop_notes)
_query(
    "grid_header_merge",
    "G7 W8",
    f"""select l_orderkey, {_JOINED.format(g='list_prepend(h, list_slice(g, 3, len(g)))')} as grid from (
      select l_orderkey, g, case when len(g) > 1 then [case when g[2][1] = 'Part' then 'Part' else 'Part ' || g[2][1] end, case when g[2][2] = 'Supplier' then 'Supplier' else 'Supplier ' || g[2][2] end, case when g[2][3] = 'State' then 'State' else 'State ' || g[2][3] end] end as h
      from (select l_orderkey, {_CLEAN} as g from grids))""",
    lambda c: g.let(cleaned(c), g.merge_header_rows),
)
_query("grid_add_columns", "G8", f"select l_orderkey, {_JOINED.format(g=_ADDED)} as grid from grids", g.add_label_columns)
_query(
    "grid_horizontals",
    "G9 G10 G11 G12 W3 G15",
    """select l_orderkey, 'Part|Supplier|State|VEC|GIS|Topic' || coalesce(';' || string_agg(case when a like 'Section%' then null else a || '|' || b || '|' || c || '|' || coalesce(label, '') || '||' end, ';' order by pos), '') as grid from (
      select l_orderkey, pos, trim(a) as a, coalesce(trim(b), '') as b, case when c = 'EnvironmentalIssues' then 'Environmental Issues' else trim(c) end as c,
        last_value(case when a like 'Section%' then a end ignore nulls) over (partition by l_orderkey order by pos rows unbounded preceding) as label from lines) group by l_orderkey""",
    lambda c: g.process(c, F.array(F.lit(5)), F.array(F.lit(5)), F.lit(None).cast(g.GRID)),
)
_query(
    "grid_fill_down",
    "G20 W2",
    """select l_orderkey, 'Part|Supplier|State' || coalesce(string_agg(';' || fa || '|' || fb || '|' || fc, '' order by pos), '') as grid from (
      select l_orderkey, pos, coalesce(last_value(nullif(trim(a), '') ignore nulls) over w, '') as fa, coalesce(last_value(nullif(trim(b), '') ignore nulls) over w, '') as fb, coalesce(last_value(nullif(case when c = 'EnvironmentalIssues' then 'Environmental Issues' else trim(c) end, '') ignore nulls) over w, '') as fc
      from lines window w as (partition by l_orderkey order by pos rows unbounded preceding)) group by l_orderkey""",
    lambda c: g.let(cleaned(c), g.fill_down),
)


@register(
    "grid_stitch",
    oracle(
        """select head_id, 'Part|State' || string_agg(';' || trim(a) || '|' || trim(c), '' order by pos) as grid from lines where relevancy = 1 group by head_id having count(*) > 1"""
    ),
    "G17 Q38 A5",
)
def grid_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = run_sql(spark, sf_dir, with_views(LINES)).where("relevancy = 1")
    head = F.array(F.lit("Part"), F.lit("State"))
    part = F.struct("level", F.array(head, F.array(g.strip(F.col("a")), g.strip(F.col("c")))).alias("grid"), F.lit(False).alias("no_header"), F.lit(1).alias("append_status"))
    chains = lines.groupBy("head_id").agg(F.collect_list(part).alias("parts")).where(F.size("parts") > 1)
    return chains.select("head_id", joined(g.stitch(F.col("parts"))).alias("grid"))


@register(
    "grid_stitch_merged",
    oracle("select head_id, 'Part|State;' || string_agg(trim(a), ' ' order by pos) || '|' || string_agg(nullif(trim(c), ''), ' ' order by pos) as grid from lines where pos % 3 <> 2 and c not like '% ' group by head_id having count(*) > 1"),
    "G17 G32",
)
def grid_stitch_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = run_sql(spark, sf_dir, with_views(LINES)).where("pos % 3 <> 2 and c not like '% '")
    head = F.array(F.lit("Part"), F.lit("State"))
    part = F.struct("level", F.array(head, F.array(g.strip(F.col("a")), g.strip(F.col("c")))).alias("grid"), F.lit(False).alias("no_header"), F.lit(2).alias("append_status"))
    chains = lines.groupBy("head_id").agg(F.collect_list(part).alias("parts")).where(F.size("parts") > 1)
    return chains.select("head_id", joined(g.stitch(F.col("parts"))).alias("grid"))


@register(
    "grid_combine",
    oracle("select l_orderkey, 'A|B' || string_agg(';' || trim(a) || '|' || cast(pos as varchar), '' order by pos) as grid from lines group by l_orderkey"),
    "G18 Q55",
)
def grid_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = run_sql(spark, sf_dir, with_views(LINES))
    part = F.struct(F.col("pos").alias("level"), F.array(F.array(F.lit("A"), F.lit("B")), F.array(g.strip(F.col("a")), F.col("pos").cast("string"))).alias("grid"))
    return lines.groupBy("l_orderkey").agg(F.collect_list(part).alias("parts")).select("l_orderkey", joined(g.combine(F.col("parts"))).alias("grid"))


@register(
    "grid_to_records",
    oracle("select l_orderkey, cast(row_number() over (partition by l_orderkey order by pos) as int) as row_index, trim(a) as part_tag, coalesce(trim(b), '') as supplier_tag, case when c = 'EnvironmentalIssues' then 'Environmental Issues' else trim(c) end as land_use from lines"),
    "G25 G24 K3",
)
def grid_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a grid: a row for each below the header, tagged columns by their header's place."""
    rows = grids(spark, sf_dir).select("l_orderkey", F.posexplode(cleaned(F.col("g"))).alias("row_index", "r")).where("row_index > 0")
    return rows.select("l_orderkey", "row_index", *[F.get("r", F.lit(i)).alias(tag) for i, tag in enumerate(("part_tag", "supplier_tag", "land_use"))])


@register("grid_metadata", oracle("select l_orderkey, cast(len(g) as int) as n_rows, cast(len(g[1]) as int) as n_columns, '[\"Part\",\"Supplier\",\"State\"]' as headers from grids"), "G22 F27 A21")
def grid_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("l_orderkey", g.metadata(F.col("g")).alias("m")).select("l_orderkey", "m.n_rows", "m.n_columns", "m.headers")


@register("grid_lengths", oracle("select min(len(g)) as low, max(len(g)) as high, round(avg(len(g)), 4) as mean, cast(sum(len(g)) as bigint) as total from grids"), "A21 A4")
def grid_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("g").cast("long")
    return grids(spark, sf_dir).agg(F.min(n).alias("low"), F.max(n).alias("high"), F.round(F.avg(n), 4).alias("mean"), F.sum(n).alias("total"))


@register("grid_width_check", oracle("select l_orderkey, cast(len(list_filter(g, lambda r: len(r) <> 3)) as int) as odd from grids"), "G16")
def grid_width_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("l_orderkey", F.size(g.odd_rows(F.col("g"), F.size(F.get("g", F.lit(0))))).alias("odd"))


@register("column_emptiness", oracle("select l_orderkey, cast(count(case when not regexp_matches(coalesce(b, ''), '[a-zA-Z0-9]') then 1 end) as int) as blank_suppliers from lines group by l_orderkey"), "A26")
def column_emptiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("l_orderkey", F.get(g.blank_cells(F.col("g")), F.lit(1)).alias("blank_suppliers"))


@register(
    "header_drift",
    with_views("select h.table_id, h.header_idx, h.title, f.title as first_title from headers h join headers f on f.table_id = h.table_id and f.header_idx = 0 where regexp_replace(lower(h.title), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(f.title), '[^a-z0-9]', '', 'g')"),
    "G23 F1",
)
def header_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = run_sql(spark, sf_dir, with_views("select * from headers"))
    first = headers.where("header_idx = 0").select("table_id", F.col("title").alias("first_title"))
    return headers.join(first, "table_id").where(g.header_key(F.col("title")) != g.header_key(F.col("first_title"))).select("table_id", "header_idx", "title", "first_title")


@register(
    "tag_permutations",
    with_views("with p as (select table_id, string_agg(cast(header_idx as varchar) || ' ' || htag, ' + ' order by header_idx, htag) as tags from header_tags group by table_id) select tags, count(*) as n, min(table_id) as example from p group by tags"),
    "G26 A19",
)
def tag_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = run_sql(spark, sf_dir, with_views("select * from header_tags"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("header_idx", "htag"))), lambda s: F.concat(s["header_idx"].cast("string"), F.lit(" "), s["htag"]))
    return tags.groupBy("table_id").agg(F.array_join(each, " + ").alias("tags")).groupBy("tags").agg(F.count(F.lit(1)).alias("n"), F.min("table_id").alias("example"))


@register("grid_annotate", oracle(f"select l_orderkey, {_JOINED.format(g=_WITH_ID)} as grid from grids"), "G29")
def grid_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = g.drop_named_column(g.annotate(F.col("g"), ["id"], [F.col("l_orderkey")]), "State")
    return grids(spark, sf_dir).select("l_orderkey", joined(out).alias("grid"))


@register("header_count", with_views("select regexp_replace(title, '\\s+', ' ', 'g') as header, count(*) as n from headers group by 1 order by n desc, header"), "G31 A18 F3")
def header_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = run_sql(spark, sf_dir, with_views("select title from headers"))
    return headers.groupBy(F.regexp_replace("title", r"\s+", " ").alias("header")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "header")
