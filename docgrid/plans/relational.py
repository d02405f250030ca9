"""The relational reports, one registered query each.

The text is SQL that Spark and DuckDB read alike, over the views of
``docgrid.plans.domain``. Where the source database groups loosely or
aggregates JSON with nulls, the queries say what is meant: ``min_by`` the
level, ordered lists.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docgrid import shared
from docgrid.plans import store
from docgrid.plans.domain import dealt, for_spark, parts_of, with_views
from docgrid.plans.registry import QUERIES, Query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_TABLE = re.compile(rf"\b(from|join)\s+({'|'.join(TABLES)})\b(?=(.{{0,12}}))", re.S)
_ALIAS = re.compile(r"\s+(?:as\s+)?(?!(?:on|where|group|left|join|inner|order|union|cross|limit|having|using|except)\b)[a-z]\w*", re.S)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables of ``sf_dir``, read by path, so that no name in the catalog is touched."""
    def scan(m: re.Match) -> str:
        alias = "" if _ALIAS.match(m[3]) else " " + m[2]
        return f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`{alias}"

    text = for_spark(sql)
    if "repartition(" in text:
        text = dealt(text, parts(spark, sf_dir))
    return spark.sql(_TABLE.sub(scan, text))


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for rows of the facts; none: few enough for Spark to choose."""
    return parts_of(shared.fingerprint(spark, f"{sf_dir}/lineitem.parquet")[0], spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, sf_dir: str, *keys: str) -> DataFrame:
    """Rows of the facts dealt by ``keys``, so that grouping or joining by them holds no more in a task as the table grows."""
    n = parts(df.sparkSession, sf_dir)
    return df.repartition(n, *keys) if n else df


def report(name: str, covers: str, sql: str, stored: bool = False, own: str | None = None) -> None:
    """Register a report; a ``stored`` one has the views that it reads repeatedly written once; ``own`` is Spark's text for the same rows."""
    whole = with_views(sql)
    text = with_views(own) if own else whole
    QUERIES[name] = Query(lambda spark, sf_dir: store.query(spark, sf_dir, sql) if stored else run_sql(spark, sf_dir, text), whole, tuple(covers.split()))


CHAIN_MANUALS = """
    select t.head_id, min_by(t.pdf_name, t.level) as pdf_name, min_by(t.page, t.level) as page, count(t.table_id) as n_tables, count(m.tag_id) as n_manual
    from doc_tables t left join table_tags m on m.table_id = t.table_id and m.tag_id = 13 {where}
    group by t.head_id"""
ALL_MANUAL = f"select * from ({CHAIN_MANUALS.format(where='')}) c where n_manual > 0 and n_manual = n_tables"

report("pdf_tables", "Q2 P3", "select t.pdf_name, p.status, t.table_id, t.page, t.level, t.relevancy, t.parent_id from doc_tables t join pdfs p on p.pdf_name = t.pdf_name")
report("pdf_tables_ordered", "Q4 O1", "select pdf_name, table_id, head_id, level, page from doc_tables where relevancy = 1 order by pdf_name, page, table_id")
report("chain_tables", "Q6 P3 O1 O3", "select head_id, table_id, level, page, relevancy from doc_tables where relevancy = 1 order by head_id, level")
report("csvs_of_locked_pdfs", "Q3 J5 P5 P21", "select csv_id, table_id, method from csvs where table_id in (select table_id from doc_tables where pdf_name in (select pdf_name from pdfs where status = 'locked'))")
report("tag_matrix", "Q5 J6 P8", """
    select t.table_id, g.tag_id, g.tag_name, case when b.tag_id is null then 'false' else 'true' end as has_tag
    from doc_tables t cross join tags g left join table_tags b on b.table_id = t.table_id and b.tag_id = g.tag_id""", own="""
    select t.table_id, g.tag_id, g.tag_name, case when h.tag is null then 'false' else 'true' end as has_tag
    from (select d.table_id, b.held from doc_tables d left join (select table_id, collect_list(tag_id) as held from table_tags group by table_id) b on b.table_id = d.table_id) t
    cross join tags g lateral view outer explode(filter(t.held, x -> x = g.tag_id)) h as tag""")  # fmt: skip
report("csv_by_method", "Q7 J7 P5", "select t.head_id, t.level, c.csv_id, c.method from doc_tables t join csvs c on c.table_id = t.table_id where c.method in ('lattice-v', 'manual') order by t.head_id, t.level")
report("tags_of_tables", "Q8 P3", "select b.table_id, g.tag_id, g.tag_name from table_tags b join tags g on g.tag_id = b.tag_id")
report("processing_index", "Q9 P24 J1 J3 A1 A2 A6 P8 P9 O1", f"""
    with manual_heads as ({ALL_MANUAL})
    select t.head_id, min_by(t.pdf_name, t.level) as pdf_name, min_by(t.page, t.level) as page, count(t.table_id) as n_tables, round(avg(t.level), 2) as mean_level,
      case when max(m.head_id) is not null then 'true' else 'false' end as all_manual,
      case when count(c.accepted) = count(t.table_id) then 'accepted' when count(c.processed) = count(t.table_id) then 'processed' when count(c.accepted) > 0 then 'partly accepted' else 'open' end as status,
      count(case when c.append_status > 0 then 1 end) as appended
    from doc_tables t join csvs c on c.csv_id = t.correct_csv left join manual_heads m on m.head_id = t.head_id
    where t.relevancy = 1 group by t.head_id order by n_tables desc, t.head_id""")  # fmt: skip
report("concat_sequence", "Q11 J3 P10 F28 W13", """
    select t.head_id, t.table_id, t.level, case when b.tag_id is null then 'headers' else 'no headers' end as header_row, coalesce(c.accepted, c.processed, '[]') as grid, c.append_status,
      lead(c.append_status, 1, 0) over (partition by t.head_id order by t.level) as next_status
    from doc_tables t join csvs c on c.csv_id = t.correct_csv left join table_tags b on b.table_id = t.table_id and b.tag_id = 1""")  # fmt: skip
report("manual_helper", "Q13 J1 J15", """
    select t.table_id, t.pdf_name, t.page, case when f.csv_id is null then 'missing' else 'present' end as file_state
    from doc_tables t join table_tags b on b.table_id = t.table_id and b.tag_id = 13 left join (select csv_id, table_id from csvs where method = 'manual') f on f.table_id = t.table_id""")  # fmt: skip
report("header_tagging_index", "Q14 J4 A7 P8", """
    select distinct t.head_id, case when t.headers_tagged = 1 then 'done' else '' end as done
    from doc_tables t where t.relevancy = 1 and not exists (select 1 from table_tags b where b.table_id = t.head_id and b.tag_id = 4)""")  # fmt: skip
report("header_tagging_detail", "Q15 Q53 J8 J19", """
    select h.table_id, h.header_idx, h.title, x.htag, m.max_tags from headers h left join header_tags x on x.table_id = h.table_id and x.header_idx = h.header_idx left join htags m on m.htag = x.htag""")  # fmt: skip
report("fully_manual_chains", "Q16 J1 J3 A5 A6", f"""
    select p.short_title, c.* from ({ALL_MANUAL}) c join pdfs d on d.pdf_name = c.pdf_name join projects p on p.application_id = d.application_id""")  # fmt: skip
report("manual_by_pdf", "Q17 A11", f"select pdf_name, cast(sum(n_tables) as bigint) as n_tables from ({ALL_MANUAL}) c group by pdf_name")
report("manual_by_project", "Q18 A11", f"""
    select p.short_title, cast(sum(c.n_tables) as bigint) as n_tables from ({ALL_MANUAL}) c join pdfs d on d.pdf_name = c.pdf_name join projects p on p.application_id = d.application_id group by p.short_title""")  # fmt: skip
report("tables_per_project", "Q19 J1 A1", "select p.short_title, count(t.table_id) as n_tables from doc_tables t join pdfs d on d.pdf_name = t.pdf_name join projects p on p.application_id = d.application_id group by p.short_title")
report("manual_ratio", "Q20 P24 J7 A12 P10", f"""
    with manual as (
      select p.short_title, cast(sum(c.n_tables) as bigint) as n_manual from (select * from ({CHAIN_MANUALS.format(where="where t.relevancy = 1")}) k where n_manual > 0 and n_manual = n_tables) c
      join pdfs d on d.pdf_name = c.pdf_name join projects p on p.application_id = d.application_id group by p.short_title
    ), totals as (
      select p.short_title, count(t.table_id) as n_all from doc_tables t join pdfs d on d.pdf_name = t.pdf_name join projects p on p.application_id = d.application_id where t.relevancy = 1 group by p.short_title
    )
    select short_title, coalesce(n_manual, 0) as n_manual, n_all, cast(round(coalesce(n_manual, 0) * 100.0 / n_all, 0) as int) as percent_manual from totals left join manual using (short_title)""")  # fmt: skip
report("partly_manual", "Q21 A5 P7", f"select * from ({CHAIN_MANUALS.format(where='')}) c where n_manual > 0 and n_manual <> n_tables")
report("partly_manual_total", "Q22 A11", f"select cast(sum(n_manual) as bigint) as do_manuals from ({CHAIN_MANUALS.format(where='')}) c where n_manual > 0 and n_manual <> n_tables")
report("manual_csvs", "Q23 J5 A5", f"select csv_id, table_id from csvs where table_id in (select t.table_id from doc_tables t join ({CHAIN_MANUALS.format(where='')}) c on c.head_id = t.head_id where c.n_manual > 0 and c.n_manual < c.n_tables)")
report("stream_not_manual", "Q24 J4", "select c.csv_id, t.head_id from csvs c join doc_tables t on t.correct_csv = c.csv_id left join table_tags b on b.table_id = t.table_id and b.tag_id = 13 where c.method = 'stream' and b.tag_id is null")
report("relevant_with_text", "Q25 Q49 J1", "select t.table_id, c.csv_text from doc_tables t join csvs c on c.csv_id = t.correct_csv where t.relevancy = 1 and c.csv_text is not null")
report("null_tags", "Q26 P4 O1", "select t.table_id, b.tag_id from doc_tables t left join table_tags b on b.table_id = t.table_id where b.tag_id is null order by t.table_id")
report("distinct_heads", "Q27 A8", "select distinct head_id from doc_tables where relevancy = 1")
report("processed_count", "Q30 A1", "select count(*) as n from csvs where processed is not null")
report("flat_file", "Q32 J12 P8 P1", """
    select p.short_title, p.application_title, d.pdf_id, d.filing_id, d.filed, d.company, t.table_id, t.page, t.combined as table_content,
      case when a.tag_id is null then '' else 'true' end as eil_one, case when b.tag_id is null then '' else 'true' end as eil_several, case when e.tag_id is null then '' else 'true' end as rating_coding
    from doc_tables t join csvs c on c.csv_id = t.correct_csv join pdfs d on d.pdf_name = t.pdf_name join projects p on p.application_id = d.application_id
    left join table_tags a on a.table_id = t.table_id and a.tag_id = 2 left join table_tags b on b.table_id = t.table_id and b.tag_id = 3 left join table_tags e on e.table_id = t.table_id and e.tag_id = 4
    where t.combined is not null""", stored=True)  # fmt: skip
report("issue_stats_median", "Q33 A4 A10 P23", """
    with counts as (select table_id, count(*) as n from issues group by table_id)
    select cast(round(avg(n), 0) as int) as mean, cast(sum(n) as bigint) as total, min(n) as low, max(n) as high, count(*) as tables,
      (select max(n) from (select n, row_number() over (order by n) as r, count(*) over () as k from counts) o where r <= (k + 1) / 2) as median_n from counts""", own="""
    with counts as (select table_id, count(*) as n from issues group by table_id)
    select cast(round(avg(n), 0) as int) as mean, cast(sum(n) as bigint) as total, min(n) as low, max(n) as high, count(*) as tables,
      cast(percentile_disc(0.5) within group (order by n) as bigint) as median_n from counts""")  # fmt: skip
report("chains_multi", "Q34 A5", "select head_id, count(*) as n from doc_tables group by head_id having count(*) > 1")
report("headers_source", "Q35 J4 A7", "select distinct t.head_id, t.combined from doc_tables t left join table_tags b on b.table_id = t.head_id and b.tag_id = 4 where b.tag_id is null and t.combined is not null and t.level = 1")
report("latest_flag", "Q36 W6", "select pdf_name, application_id, monitoring_year, case when monitoring_year = max(monitoring_year) over (partition by application_id) then 1 else 0 end as latest from pdfs")
report("fully_accepted", "Q37 A3 A5", """
    select t.head_id, cast(sum(case when c.append_status = 0 then 0 else 1 end) as bigint) as marked, count(*) as n from doc_tables t join csvs c on c.csv_id = t.correct_csv where t.relevancy = 1
    group by t.head_id having count(t.head_id) = count(c.accepted) and sum(case when c.append_status = 0 then 0 else 1 end) + 1 = count(*)""")  # fmt: skip
report("stitch_sequence", "Q38 J3 O1", "select t.head_id, t.level, c.accepted, c.append_status, b.tag_id as no_header from doc_tables t join csvs c on c.csv_id = t.correct_csv left join table_tags b on b.table_id = t.table_id and b.tag_id = 1 where t.relevancy = 1")
report("needs_forward_fill", "Q39 P5", "select distinct t.table_id, t.combined from doc_tables t join table_tags b on b.table_id = t.table_id where b.tag_id in (5, 12, 14, 15) and t.combined is not null")
report("issues_in_tag5", "Q40 J10 J11", "select distinct i.* from issues i left join doc_tables t on i.table_id = t.head_id left join table_tags b on b.table_id = t.table_id where b.tag_id = 5")
report("issues_with_land_use", "Q41 P25 P7", "select i.table_id, i.row_index, u.nrcan from issues i join (select l.table_id, l.row_index, m.nrcan, m.sysops from land_use l join land_names m on m.land_id = l.land_id) u on u.table_id = i.table_id and u.row_index = i.row_index where u.sysops <> 'sys ASIA'")
report("issues_without_two", "Q42 P5", "select table_id, count(*) as n from issues where table_id not in ('t1-1', 't2-1') group by table_id")
report("land_descriptions", "Q43 P4", "select distinct nrcan, sysops from land_names where sysops is not null")
report("complete_issues", "Q44 J13 P7", """
    select distinct p.short_title, d.company, d.filed, t.head_id, i.row_index, i.content, i.status, s.row_counter, s.issue_parsed, w.vec, l.loc_text, u.land_id
    from issues i join doc_tables t on i.table_id = t.head_id join pdfs d on d.pdf_name = t.pdf_name join projects p on p.application_id = d.application_id
    left join parsed s on s.table_id = i.table_id and s.row_index = i.row_index left join word_labels w on w.table_id = i.table_id and w.row_index = i.row_index
    left join locations l on l.table_id = i.table_id and l.row_index = i.row_index left join land_use u on u.table_id = l.table_id and u.row_index = l.row_index and u.loc_no = l.loc_no
    where i.issue_pri not in ('-', '?', 'ESC') and concat(i.issue_pri, coalesce(i.status, '')) <> ''""", stored=True)  # fmt: skip
VIZ = """
    select i.table_id, i.row_index, p.row_counter, s.sub_vec, w.vec from issues i join (select * from word_labels where row_counter is {some}) p on p.table_id = i.table_id and p.row_index = i.row_index
    left join sub_labels s on s.table_id = p.table_id and s.row_index = p.row_index {also} join word_labels w on w.table_id = p.table_id and w.row_index = p.row_index and coalesce(w.row_counter, 0) = {counter}
    where not (w.vec = 'Soils' and s.sub_vec is null)"""
# an OR in a join's condition can't be hashed: two equi joins, one for each side of it
report("viz_join_or", "Q47 J9 P11", VIZ.format(some="not null", also="and s.row_counter = p.row_counter", counter="p.row_counter") + " union all " + VIZ.format(some="null", also="", counter="0"), stored=True)
report("orphan_ids", "Q50 K13 U3 J15", "select csv_id from csvs where method = 'manual' except select correct_csv from doc_tables where correct_csv is not null")
report("classifier_inputs", "Q51 P3 O1", "select l.vec, l.short_name, l.test_order, k.phrase from labels_list l left join keywords k on k.vec = l.vec order by l.test_order, k.phrase")
report("chain_headers", "Q52 J2 J4", "select h.table_id, h.header_idx, h.title, t.level from headers h join doc_tables t on t.table_id = h.table_id left join table_tags b on b.table_id = t.table_id and b.tag_id = 1 where b.tag_id is null")
report("issues_without_meridian", "Q54 P4", "select table_id, row_index, loc_coord from issues where loc_mer is null")
report("inter_pdf_groups", "Q55 P4 A7 O1", "select inter_head, inter_level, table_id from doc_tables where inter_head is not null union all select null, null, table_id from doc_tables where inter_head is null and level = 1")
report("accepted_grids", "Q56 P4", "select csv_id, accepted from csvs where accepted is not null")
report("issue_samples", "Q57 P6 P5", "select table_id, row_index, content from issues where content not like '%VEC%' and land_use in ('Pasture', 'Crop')")
report("flat_without_rating", "Q58 P3", "select t.table_id, t.combined from doc_tables t left join table_tags b on b.table_id = t.table_id and b.tag_id = 4 where t.combined is not null and b.tag_id is null")
report("header_index_of_tag", "Q59 P3", "select table_id, min(header_idx) as header_idx from header_tags where htag = 'EUROPE' group by table_id")
report("scan_with_exclusions", "Q60 P2 P5", "select * from parsed where table_id not in ('t5-1', 't6-1', 't7-4') and (row_counter in (1, 2))")
report("page_candidates", "J22 W7 P22", """
    select a.table_id, b.table_id as candidate, a.page - b.page as back from doc_tables a join doc_tables b on b.pdf_name = a.pdf_name and a.page - b.page between 0 and 1 and a.table_id <> b.table_id
    where not exists (select 1 from doc_tables c where c.parent_id = b.table_id)""", own="""
    select a.table_id, b.table_id as candidate, a.page - b.page as back from (select /*+ repartition(pdf_name) */ * from doc_tables) a
    join (select /*+ repartition(pdf_name) */ b.* from (select /*+ repartition(table_id) */ * from doc_tables) b left anti join (select /*+ repartition(parent_id) */ parent_id from doc_tables) c on c.parent_id = b.table_id) b
    on b.pdf_name = a.pdf_name and a.page - b.page between 0 and 1 and a.table_id <> b.table_id""")  # fmt: skip
report("quick_continuation", "J23 A5", "select a.table_id, min(b.table_id) as parent_id from doc_tables a join doc_tables b on b.pdf_name = a.pdf_name and b.page = a.page - 1 group by a.table_id having count(*) = 1")
report("head_flag", "P22 J20", "select t.table_id, case when t.parent_id is null and k.parent_id is not null then 1 else 0 end as is_head from doc_tables t left join (select distinct parent_id from doc_tables where parent_id is not null) k on k.parent_id = t.table_id")
report("totals_cube", "A24", """
    select coalesce(d.company, 'All') as company, coalesce(i.status, 'All') as status, count(*) as n, cast(grouping(d.company) as int) as g1, cast(grouping(i.status) as int) as g2
    from (select table_id, coalesce(status, 'none') as status from issues) i join doc_tables t on t.table_id = i.table_id join pdfs d on d.pdf_name = t.pdf_name group by cube (d.company, i.status)""")  # fmt: skip
report("count_in_list", "A25 P12", "select count(*) as n from issues where table_id in (select head_id from doc_tables where headers_tagged = 1)")
report("format_summary", "A22 A12", "select loc_format, count(*) as n, cast(round(count(*) * 100.0 / (select count(*) from locations), 2) as double) as percent from locations group by loc_format")
report("histogram_first_example", "A18 A19 A20 O5", "select title, count(*) as n, min(table_id) as example from headers group by title order by n desc, title")
