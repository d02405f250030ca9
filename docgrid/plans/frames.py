"""Queries of the mutations and of the ordered, set and reporting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrid.operators import frames as f
from docgrid.operators import mutations as m
from docgrid.operators.trees import down
from docgrid.plans.domain import with_views
from docgrid.plans.registry import register, table
from docgrid.plans.relational import run_sql, spread


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, with_views(f"select * from {name}"))


def _put(name: str, covers: str, sql: str):
    return register(name, with_views(sql), covers)


@_put("insert_rows", "K1 K14 U1", "select table_id, tag_id from table_tags union all select table_id, 99 from doc_tables where level = 1")
def insert_rows(s, d):
    return m.insert(view(s, d, "table_tags"), view(s, d, "doc_tables").where("level = 1").select("table_id", F.lit(99).alias("tag_id")))


@_put("keyed_update", "K2 J19", "select c.csv_id, c.method, case when n.csv_id is not null then n.processed else c.accepted end as accepted from csvs c left join (select csv_id, processed from csvs where append_status = 1) n on n.csv_id = c.csv_id")
def keyed_update(s, d):
    csvs = view(s, d, "csvs")
    new = csvs.where("append_status = 1").select("csv_id", F.col("processed").alias("accepted"))
    return m.update(csvs.select("csv_id", "method", "accepted"), new, ["csv_id"], ["accepted"])


@_put("column_reset", "K4 K12 K7", "select csv_id, cast(null as varchar) as processed, case when append_status = 2 then null else accepted end as accepted from csvs")
def column_reset(s, d):
    csvs = view(s, d, "csvs").select("csv_id", "processed", "accepted", "append_status")
    out = m.update_where(m.update_where(csvs, "processed", F.lit(None)), "accepted", F.lit(None), F.col("append_status") == 2)
    return out.drop("append_status")


@_put("pivot_tags", "K3 A16", "select table_id, max(case when tag_id = 1 then tag_id end) as t1, max(case when tag_id = 5 then tag_id end) as t5, max(case when tag_id = 13 then tag_id end) as t13 from table_tags where tag_id in (1, 5, 13) group by table_id")
def pivot_tags(s, d):
    tags = view(s, d, "table_tags").where("tag_id in (1, 5, 13)").withColumn("name", F.concat(F.lit("t"), F.col("tag_id").cast("string")))
    return m.pivot_update(spread(tags, d, "table_id"), ["table_id"], "name", "tag_id", "tag_id", ["t1", "t5", "t13"])


@_put(
    "upsert_headers",
    "K5 G24",
    """select coalesce(o.table_id, n.table_id) as table_id, coalesce(o.header_idx, n.header_idx) as header_idx, case when n.table_id is null then o.title else n.title end as title,
      case when n.table_id is null then 'keep' when o.table_id is null then 'insert' when o.title is not distinct from n.title then 'same' else 'update' end as action
    from (select * from headers where header_idx < 2) o full join (select table_id, header_idx, case when length(table_id) % 3 = 0 then upper(title) else title end as title from headers where header_idx > 0) n on n.table_id = o.table_id and n.header_idx = o.header_idx""",
)
def upsert_headers(s, d):
    headers = view(s, d, "headers")
    new = headers.where("header_idx > 0").withColumn("title", F.when(F.length("table_id") % 3 == 0, F.upper("title")).otherwise(F.col("title")))
    return m.upsert(headers.where("header_idx < 2"), new, ["table_id", "header_idx"], ["title"])


@_put("insert_absent", "K6 J4", "select distinct phrase from (select lower(p_type) as phrase from part) p where phrase not in (select lower(p_type) from part where p_size > 49) union select distinct lower(p_name) from part where p_size < 3 and lower(p_name) not in (select lower(p_type) from part where p_size > 49)")
def insert_absent(s, d):
    part = table(s, d, "part")
    old = part.where("p_size > 49").select(F.lower("p_type").alias("phrase"))
    new = part.select(F.lower("p_type").alias("phrase")).union(part.where("p_size < 3").select(F.lower("p_name")))
    return m.insert_absent(old, new, ["phrase"])


@_put("value_map", "K8 P20", "select table_id, row_index, case land_use when 'Pasture' then 'Agriculture' when 'Crop' then 'Agriculture' else land_use end as land_use from issues")
def value_map(s, d):
    names = s.createDataFrame([("Pasture", "Agriculture"), ("Crop", "Agriculture")], "old string, new string")
    return m.update_values(view(s, d, "issues").select("table_id", "row_index", "land_use"), names, "land_use")


@_put("confidence", "K9 F33", "select table_id, row_index, round(abs(unres_prob - res_prob) * 100, 6) as confidence from issues")
def confidence(s, d):
    return view(s, d, "issues").select("table_id", "row_index", F.round(F.abs(F.col("unres_prob") - F.col("res_prob")) * 100, 6).alias("confidence"))


@_put("delete_by_tag", "K10", "select b.table_id, b.tag_id from table_tags b where not (b.tag_id = 13 and b.table_id in (select table_id from doc_tables where level = 2))")
def delete_by_tag(s, d):
    gone = view(s, d, "doc_tables").where("level = 2").select("table_id", F.lit(13).alias("tag_id"))
    return m.delete(view(s, d, "table_tags"), gone, ["table_id", "tag_id"])


@_put("cascade_delete", "K11", "select csv_id as id from csvs where table_id not in (select table_id from doc_tables where relevancy = 0 and level = 1) union all select table_id from doc_tables where not (relevancy = 0 and level = 1)")
def cascade_delete(s, d):
    tables = view(s, d, "doc_tables")
    parents, children = m.cascade_delete(tables, view(s, d, "csvs"), tables.where("relevancy = 0 and level = 1"), "table_id")
    return children.select(F.col("csv_id").alias("id")).union(parents.select("table_id"))


@_put("chain_propagate", "K20", "select t.table_id, case when h.head_id is not null then 0 else t.relevancy end as relevancy from doc_tables t left join (select head_id from doc_tables where level = 1 and part % 2 = 0) h on h.head_id = t.head_id")
def chain_propagate(s, d):
    tables = view(s, d, "doc_tables")
    heads = tables.where("level = 1 and part % 2 = 0").select("head_id", F.lit(0).alias("relevancy"))
    return m.to_chain(tables.select("table_id", "head_id", "relevancy"), heads, ["relevancy"]).select("table_id", "relevancy")


@_put("orphans", "K13 U3", "select distinct o_custkey as key from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def orphans(s, d):
    return m.orphans(table(s, d, "orders").select(F.col("o_custkey").alias("key")), table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key")


@_put("row_counter", "W1 F25", "select conv_id, turn, role, cast(row_number() over (partition by conv_id, role order by turn) as int) as row_counter from conversations")
def row_counter(s, d):
    return f.row_counter(table(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], ["turn"])


@_put("keep_last", "W4", "select conv_id, role, turn from (select *, row_number() over (partition by conv_id, role order by turn desc) as r from conversations) c where r = 1")
def keep_last(s, d):
    return f.keep_last(table(s, d, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], ["turn"])


@_put("keep_first", "W5", "select user_id, min(event_id) as event_id from events group by user_id")
def keep_first(s, d):
    return f.keep_first(table(s, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@_put("forward_fill", "W2 W3", "select user_id, event_id, last_value(case when event_type <> 'click' then event_type end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as label from events")
def forward_fill(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("label"))
    return f.forward_fill(e, ["user_id"], ["event_id"], ["label"])


@_put("latest_per_group", "W6", "select o_orderkey, o_custkey from (select *, max(year(o_orderdate)) over (partition by o_custkey) as m from orders) o where year(o_orderdate) = m")
def latest_per_group(s, d):
    return f.latest(table(s, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")), ["o_custkey"], "y").drop("y")


@_put("chain_levels", "W7 J20", "select table_id, level from doc_tables")
def chain_levels(s, d):
    """Levels from the parent pointers alone."""
    links = run_sql(s, d, with_views("select table_id, parent_id from doc_tables"))
    return down(links, ["table_id"], "parent_id").select("table_id", (F.col("up") + 1).alias("level"))


@_put("page_runs", "W9", "select l_orderkey, l_linenumber, min(l_linenumber) over (partition by l_orderkey, g) as run from (select l_orderkey, l_linenumber, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as g from captured) x")
def page_runs(s, d):
    return f.runs(view(s, d, "captured").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@_put("line_blocks", "W10 W11", "select user_id, event_id, cast(sum(case when p is null or p <> event_type then 1 else 0 end) over (partition by user_id order by event_id) as bigint) as block from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) e")
def line_blocks(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(s, d, "events").withColumn("p", F.lag("event_type").over(w))
    return f.merge_runs(e, ["user_id"], "event_id", F.col("p").isNull() | (F.col("p") != F.col("event_type"))).select("user_id", "event_id", "block")


@_put("pair_adjacent", "W12", "select user_id, event_id, n as next_id from (select *, lead(event_id) over (partition by user_id order by event_id) as n, lead(event_type) over (partition by user_id order by event_id) as t from events) e where event_type = 'view' and t = 'purchase'")
def pair_adjacent(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.lead("event_id").over(w).alias("next_id"), F.lead("event_type").over(w).alias("t"))
    return e.where("event_type = 'view' and t = 'purchase'").select("user_id", "event_id", "next_id")


@_put("next_status", "W13", "select table_id, lead(append_status, 1, 0) over (partition by split_part(table_id, '-', 1) order by csv_id) as next_status from csvs")
def next_status(s, d):
    w = Window.partitionBy(F.split_part("table_id", F.lit("-"), F.lit(1))).orderBy("csv_id")
    return view(s, d, "csvs").select("table_id", F.lead("append_status", 1, 0).over(w).alias("next_status"))


@_put("top_two_heights", "O7", "select l_orderkey, l_quantity from (select distinct l_orderkey, l_quantity, dense_rank() over (partition by l_orderkey order by l_quantity desc) as r from lineitem) x where r <= 2")
def top_two_heights(s, d):
    return f.top_values(table(s, d, "lineitem"), ["l_orderkey"], "l_quantity", 2)


@_put("topk_per_group", "O6 O1 O3 O11", "select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer) c where r <= 3")
def topk_per_group(s, d):
    return f.top_k(table(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@register("seeded_sample", None, "O4 Q57")
def seeded_sample(s, d):
    """150 documents in a reproducible random order; sampling is what the operator is for."""
    return table(s, d, "documents").where("text not like '%VEC%'").orderBy(F.xxhash64(F.lit(150), "doc_id"), "doc_id").limit(150).select("doc_id", "lang")


@_put("string_set_join", "A13 A14 Q45", "select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ', ') as o_orderstatus, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') as o_orderpriority from orders group by o_custkey")
def string_set_join(s, d):
    return f.string_sets(table(s, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@_put("tag_lists_with_nulls", "A9 Q28", "select t.table_id, coalesce(string_agg(cast(b.tag_id as varchar), ',' order by b.tag_id), '') as tags from doc_tables t left join table_tags b on b.table_id = t.table_id group by t.table_id")
def tag_lists_with_nulls(s, d):
    joined = spread(view(s, d, "doc_tables").select("table_id"), d, "table_id").join(spread(view(s, d, "table_tags"), d, "table_id"), "table_id", "left")
    return f.lists_with_nulls(joined, ["table_id"], "tag_id", "tag_id", "tags").select("table_id", F.array_join(F.transform("tags", lambda x: x.cast("string")), ",").alias("tags"))


@_put("flat_unique_lists", "A15 U4 F44", "select o_custkey, array_to_string(list_sort(list_distinct(flatten(list([o_orderstatus, substr(o_orderpriority, 1, 1)])))), ',') as seen from orders group by o_custkey")
def flat_unique_lists(s, d):
    o = table(s, d, "orders").select("o_custkey", F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("x"))
    return f.flat_unique(o, ["o_custkey"], "x", "seen").select("o_custkey", F.array_join("seen", ",").alias("seen"))


@_put("landuse_onehot", "A16 Q48", "select table_id, count(case when land_use = 'Pasture' then 1 end) as Pasture, count(case when land_use = 'Crop' then 1 end) as Crop, count(case when land_use = 'Bush' then 1 end) as Bush from issues group by table_id")
def landuse_onehot(s, d):
    return f.one_hot(view(s, d, "issues"), ["table_id"], "land_use", ["Pasture", "Crop", "Bush"])


@_put("one_hot_names", "A17", "select table_id, case when count(case when land_use = 'Pasture' then 1 end) > 0 then 'Pasture' else '0' end as Pasture, case when count(case when land_use = 'Crop' then 1 end) > 0 then 'Crop' else '0' end as Crop from issues group by table_id")
def one_hot_names(s, d):
    return f.one_hot(view(s, d, "issues"), ["table_id"], "land_use", ["Pasture", "Crop"], names=True)


PAIRS = ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"), ("l_quantity", "l_extendedprice")


@_put("corr_matrix", "A23 X14 O10", " union all ".join(f"select '{a}' as a, '{b}' as b, round(abs(corr({a}, {b})), 6) as r from lineitem" for a, b in PAIRS))
def corr_matrix(s, d):
    one = table(s, d, "lineitem").agg(*[F.round(F.abs(F.corr(a, b)), 6).alias(f"{a},{b}") for a, b in PAIRS])
    return one.unpivot([], list(one.columns), "pair", "r").select(F.split_part("pair", F.lit(","), F.lit(1)).alias("a"), F.split_part("pair", F.lit(","), F.lit(2)).alias("b"), "r").orderBy(F.desc("r"))


@_put("systemops_export", "U1 A13", "select table_id, row_index, cast(null as int) as row_counter, issue_pri as issue, status from issues union all select table_id, row_index, row_counter, issue_parsed, status from parsed")
def systemops_export(s, d):
    issues = view(s, d, "issues").select("table_id", "row_index", F.col("issue_pri").alias("issue"), "status")
    return m.insert(issues, view(s, d, "parsed").select("table_id", "row_index", "row_counter", F.col("issue_parsed").alias("issue"), "status")).select("table_id", "row_index", "row_counter", "issue", "status")


@_put("zip_rows", "J21 P14", "select coalesce(a.conv_id, b.conv_id) as conv_id, a.text as said, b.text as answered from (select *, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'user') a full join (select *, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'assistant') b on a.conv_id = b.conv_id and a.i = b.i")
def zip_rows(s, d):
    c = table(s, d, "conversations")
    a, b = (c.where(F.col("role") == r).select("conv_id", F.col("turn").alias("turn"), F.col("text").alias(n)) for r, n in (("user", "said"), ("assistant", "answered")))
    return f.zip_rows(a, b, ["conv_id"], ["turn"]).select("conv_id", "said", "answered")


@_put("interleave", "U6 F45", "select item_id, cast(u.line as int) as line, case u.line when 0 then text when 1 then concat('> ', text) else '' end as text from benchmark cross join (select unnest([0, 1, 2]) as line) u")
def interleave(s, d):
    return f.interleave(table(s, d, "benchmark").withColumn("up", F.concat(F.lit("> "), F.col("text"))), ["item_id"], "text", "up")


@_put("incremental_work", "Q49 P4", "select csv_id from csvs where accepted is null and processed is not null")
def incremental_work(s, d):
    """What is left to do: by marker, and by the table of what is done."""
    csvs = view(s, d, "csvs")
    return csvs.where("processed is not null").join(csvs.where("accepted is not null").select("csv_id"), "csv_id", "left_anti").select("csv_id")


@_put("subset_and_strings", "P15 P17 P18 P19 O2", "select cast(c_custkey as varchar) as c_custkey, trim(c_name) as c_name, case when c_acctbal < 0 then 'debt' when c_nationkey = 1 then 'one' else c_mktsegment end as c_mktsegment from customer")
def subset_and_strings(s, d):
    from docgrid.functions.text import all_strings, set_where

    c = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    out = set_where(c, "c_mktsegment", [(F.col("c_acctbal") < 0, "debt"), (F.col("c_nationkey") == 1, "one")])
    return all_strings(out.select("c_custkey", "c_name", "c_mktsegment"), strip=True)


@_put("event_windows", "A4", "select event_type, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def event_windows(s, d):
    from docgrid.streaming.increment import counts_by_window

    return counts_by_window(table(s, d, "events")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total")
