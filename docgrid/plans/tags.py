"""Reports with tag lists: each table's own tags and those of its whole chain, as ordered lists.

The plans are DataFrames; the SQL is written apart from them. A list is text
like ``[1,5,13]``, ``[]`` for a table or chain without tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.plans import store
from docgrid.plans.domain import with_views
from docgrid.plans.registry import register

#: Tag of tables that are processed by hand.
BY_HAND = 13


def _view(spark: SparkSession, sf_dir: str, name: str, columns: str = "*") -> DataFrame:
    return store.view(spark, sf_dir, name).selectExpr(*columns.split(", "))


def _listed(values: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(F.array_sort(values), lambda x: x.cast("string")), ","), F.lit("")), F.lit("]"))


def own_tags(tags: DataFrame) -> DataFrame:
    """(table_id, tags): a table's tags."""
    return tags.groupBy("table_id").agg(F.collect_set("tag_id").alias("tags"))


def chain_tags(tables: DataFrame, tags: DataFrame) -> DataFrame:
    """(head_id, all_tags): the distinct tags of the relevant tables of a chain."""
    return tables.where("relevancy = 1").select("head_id", "table_id").join(tags, "table_id").groupBy("head_id").agg(F.collect_set("tag_id").alias("all_tags"))


def by_hand(tables: DataFrame, tags: DataFrame) -> DataFrame:
    """head_id of the chains all of whose relevant tables are processed by hand."""
    marked = tables.where("relevancy = 1").join(tags.where(F.col("tag_id") == BY_HAND).select("table_id", "tag_id"), "table_id", "left")
    return marked.groupBy("head_id").agg(F.count(F.lit(1)).alias("n"), F.count("tag_id").alias("m")).where("m = n").select("head_id", F.lit("true").alias("hand"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _view(spark, sf_dir, "doc_tables"), _view(spark, sf_dir, "table_tags")


_OWN = "select table_id, concat('[', string_agg(cast(tag_id as varchar), ',' order by tag_id), ']') as tags from table_tags group by table_id"
_CHAIN = """select head_id, concat('[', string_agg(cast(tag_id as varchar), ',' order by tag_id), ']') as all_tags
    from (select distinct t.head_id, b.tag_id from doc_tables t join table_tags b on b.table_id = t.table_id where t.relevancy = 1) x group by head_id"""
_HAND = """select t.head_id from doc_tables t left join (select table_id from table_tags where tag_id = 13) b on b.table_id = t.table_id
    where t.relevancy = 1 group by t.head_id having count(*) = count(b.table_id)"""
_LISTS = f"with own as ({_OWN}), chain as ({_CHAIN})"


@register("processing_sequence", with_views(f"{_LISTS} select t.head_id, t.table_id, t.level, c.csv_text, c.processed, coalesce(o.tags, '[]') as tags from doc_tables t join csvs c on c.csv_id = t.correct_csv left join own o on o.table_id = t.table_id where t.relevancy = 1"), "Q10 J1 J2 A9")
def processing_sequence(s, d):
    tables, tags = _parts(s, d)
    grids = _view(s, d, "csvs", "csv_id as correct_csv, csv_text, processed")
    out = tables.where("relevancy = 1").join(grids, "correct_csv").join(own_tags(tags), "table_id", "left")
    return out.select("head_id", "table_id", "level", "csv_text", "processed", _listed(F.col("tags")).alias("tags"))


@register("chain_and_own_tags", with_views(f"{_LISTS} select t.table_id, t.head_id, t.level, coalesce(o.tags, '[]') as tags, coalesce(w.all_tags, '[]') as all_tags from doc_tables t left join own o on o.table_id = t.table_id left join chain w on w.head_id = t.head_id where t.relevancy = 1"), "Q28 A7 A9")
def chain_and_own_tags(s, d):
    tables, tags = _parts(s, d)
    out = tables.where("relevancy = 1").join(own_tags(tags), "table_id", "left").join(chain_tags(tables, tags), "head_id", "left")
    return out.select("table_id", "head_id", "level", _listed(F.col("tags")).alias("tags"), _listed(F.col("all_tags")).alias("all_tags"))


@register(
    "pipeline_input",
    with_views(
        f"{_LISTS}, hand as ({_HAND}) select t.table_id, t.head_id, t.level, t.correct_csv, c.csv_text, coalesce(o.tags, '[]') as tags, coalesce(w.all_tags, '[]') as all_tags, case when h.head_id is null then 'false' else 'true' end as all_manual"
        " from doc_tables t left join csvs c on c.csv_id = t.correct_csv left join own o on o.table_id = t.table_id left join chain w on w.head_id = t.head_id left join hand h on h.head_id = t.head_id where t.relevancy = 1 and c.accepted is null"
    ),
    "Q29 A9 P8",
)
def pipeline_input(s, d):
    tables, tags = _parts(s, d)
    grids = _view(s, d, "csvs", "csv_id as correct_csv, csv_text, accepted")
    out = tables.where("relevancy = 1").join(grids, "correct_csv", "left").where("accepted is null").join(own_tags(tags), "table_id", "left")
    out = out.join(chain_tags(tables, tags), "head_id", "left").join(by_hand(tables, tags), "head_id", "left")
    return out.select("table_id", "head_id", "level", "correct_csv", "csv_text", _listed(F.col("tags")).alias("tags"), _listed(F.col("all_tags")).alias("all_tags"), F.coalesce("hand", F.lit("false")).alias("all_manual"))


@register("tables_by_tag", with_views(f"{_LISTS} select t.table_id, t.pdf_name, c.csv_text, o.tags, coalesce(w.all_tags, '[]') as all_tags from doc_tables t join table_tags g on g.table_id = t.table_id and g.tag_id = 6 join own o on o.table_id = t.table_id left join csvs c on c.csv_id = t.correct_csv left join chain w on w.head_id = t.head_id"), "Q12 Q31 A9")
def tables_by_tag(s, d):
    tables, tags = _parts(s, d)
    grids = _view(s, d, "csvs", "csv_id as correct_csv, csv_text")
    out = tables.join(own_tags(tags).where(F.array_contains("tags", 6)), "table_id").join(grids, "correct_csv", "left").join(chain_tags(tables, tags), "head_id", "left")
    return out.select("table_id", "pdf_name", "csv_text", _listed(F.col("tags")).alias("tags"), _listed(F.col("all_tags")).alias("all_tags"))


@register(
    "systemops_flat",
    with_views(
        """select p.short_title, d.company, d.filed, t.head_id, i.row_index, i.content, 'row' as grain, cast(null as int) as row_counter, i.status, l.loc_text, m.nrcan
        from issues i join doc_tables t on t.table_id = i.table_id join pdfs d on d.pdf_name = t.pdf_name join projects p on p.application_id = d.application_id
        left join (select * from locations where loc_no = 1) l on l.table_id = i.table_id and l.row_index = i.row_index left join land_use u on u.table_id = l.table_id and u.row_index = l.row_index and u.loc_no = l.loc_no left join land_names m on m.land_id = u.land_id
        union all
        select p.short_title, d.company, d.filed, t.head_id, i.row_index, i.issue_parsed, 'parsed', i.row_counter, i.status, l.loc_text, m.nrcan
        from parsed i join doc_tables t on t.table_id = i.table_id join pdfs d on d.pdf_name = t.pdf_name join projects p on p.application_id = d.application_id
        left join (select * from locations where loc_no = 1) l on l.table_id = i.table_id and l.row_index = i.row_index left join land_use u on u.table_id = l.table_id and u.row_index = l.row_index and u.loc_no = l.loc_no left join land_names m on m.land_id = u.land_id"""
    ),
    "Q45 U1 J13",
)
def systemops_flat(s, d):
    """Issues and parsed issues in one export, both with project, document, place and land use."""
    row, none = ["table_id", "row_index"], F.lit(None).cast("int")
    issues = _view(s, d, "issues").select(*row, "content", F.lit("row").alias("grain"), none.alias("row_counter"), "status")
    parsed = _view(s, d, "parsed").select(*row, F.col("issue_parsed").alias("content"), F.lit("parsed").alias("grain"), "row_counter", "status")
    place = _view(s, d, "locations").where("loc_no = 1").join(_view(s, d, "land_use"), [*row, "loc_no"], "left").join(_view(s, d, "land_names"), "land_id", "left")
    whose = _view(s, d, "doc_tables", "table_id, head_id, pdf_name").join(_view(s, d, "pdfs").drop("status"), "pdf_name").join(_view(s, d, "projects"), "application_id")
    out = issues.unionByName(parsed).join(whose, "table_id").join(place.select(*row, "loc_text", "nrcan"), row, "left")
    return out.select("short_title", "company", "filed", "head_id", "row_index", "content", "grain", "row_counter", "status", "loc_text", "nrcan")


def _without(spark: SparkSession, sf_dir: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """[Q46] ``rows`` that have no sub-label by ``keys``, once each, with all their labels in one text."""
    bare = rows.join(_view(spark, sf_dir, "sub_labels").where("sub_vec is not null").select(*keys), keys, "left_anti")
    vecs = _view(spark, sf_dir, "word_labels").select(*keys, F.coalesce("vec", F.lit("")).alias("vec")).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("vec")), ", ").alias("vecs"))
    return bare.dropDuplicates(keys).join(vecs, keys, "left").withColumn("vecs", F.coalesce("vecs", F.lit("")))


_BARE = """with r as (select distinct {keys}, {rest}, coalesce(w.vec, '') as vec from {of} left join sub_labels s on {s} left join word_labels w on {w} where s.sub_vec is null {more})
    select {plain}, string_agg(vec, ', ' order by vec) as vecs from r group by {plain}"""
_ROW = "{0}.table_id = i.table_id and {0}.row_index = i.row_index"


@register("without_sublabels", with_views(_BARE.format(keys="i.table_id, i.row_index", rest="i.vec_pri, i.issue_pri", of="issues i left join parsed p on p.table_id = i.table_id and p.row_index = i.row_index", s=_ROW.format("s"), w=_ROW.format("w"), more="and i.status is not null", plain="table_id, row_index, vec_pri, issue_pri")), "Q46 A14 W4")
def without_sublabels(s, d):
    return _without(s, d, _view(s, d, "issues", "table_id, row_index, vec_pri, issue_pri, status").where("status is not null").drop("status"), ["table_id", "row_index"])


@register("without_sublabels_parsed", with_views(_BARE.format(keys="i.table_id, i.row_index, i.row_counter", rest="i.issue_parsed", of="parsed i", s=_ROW.format("s") + " and s.row_counter = i.row_counter", w=_ROW.format("w") + " and w.row_counter = i.row_counter", more="", plain="table_id, row_index, row_counter, issue_parsed")), "Q46 A14 W4")
def without_sublabels_parsed(s, d):
    return _without(s, d, _view(s, d, "parsed", "table_id, row_index, row_counter, issue_parsed"), ["table_id", "row_index", "row_counter"])


@register("merge_suffixes", with_views("select a.table_id, a.row_index, a.status as status_x, b.status as status_y, a.content, b.issue_parsed from issues a left join parsed b on b.table_id = a.table_id and b.row_index = a.row_index"), "J14")
def merge_suffixes(s, d):
    """A left merge on keys; columns of both sides of one name get _x and _y."""
    left, right, on = _view(s, d, "issues", "table_id, row_index, status, content"), _view(s, d, "parsed", "table_id, row_index, status, issue_parsed"), ["table_id", "row_index"]
    return merged(left, right, on)


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """[J14] A join on ``on``; other columns that both sides have are told apart by _x and _y."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    named = lambda df, end: df.select(*[F.col(c).alias(c + end if c in both else c) for c in df.columns])
    return named(left, "_x").join(named(right, "_y"), on, how)
