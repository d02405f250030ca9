"""The document-table domain as views over the test tables.

Projects own PDFs, PDFs own captured tables, tables form chains over pages
(head, level), carry tags and point to one extracted CSV; their rows become
issues. Every view is SQL that Spark and DuckDB read alike, so a query and its
check share one definition of the data. ``with_views`` puts in front of a query
the views that it needs, and only those; Catalyst inlines and prunes them.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "captured": """
        select l_orderkey, l_linenumber, max(l_partkey) as part, max(l_suppkey) as supp, max(l_quantity) as quantity, max(l_discount) as discount,
          max(l_tax) as tax, max(l_returnflag) as flag, max(l_linestatus) as state, max(l_shipdate) as shipped
        from lineitem group by l_orderkey, l_linenumber""",
    "spots": "select *, row_number() over (partition by l_orderkey order by l_linenumber) as pos from captured",
    "projects": "select c_custkey as application_id, c_name as application_title, concat(c_mktsegment, '-', cast(c_nationkey as varchar(9))) as short_title from customer",
    "pdfs": """
        select o_orderkey as pdf_id, concat('p', cast(o_orderkey as varchar(20))) as pdf_name, o_totalprice as pdf_size, o_orderkey % 997 as filing_id,
          cast(cast(o_orderdate as date) as varchar(10)) as filed, case when o_orderstatus = 'F' then 'locked' else '' end as status, o_orderpriority as company,
          o_custkey as application_id, year(o_orderdate) as monitoring_year
        from orders""",
    "doc_tables": """
        select concat('t', cast(l_orderkey as varchar(20)), '-', cast(pos as varchar(9))) as table_id, concat('p', cast(l_orderkey as varchar(20))) as pdf_name,
          l_linenumber as page, concat('t', cast(l_orderkey as varchar(20)), '-', cast(pos - (pos - 1) % 3 as varchar(9))) as head_id, (pos - 1) % 3 + 1 as level,
          case when (pos - 1) % 3 > 0 then concat('t', cast(l_orderkey as varchar(20)), '-', cast(pos - 1 as varchar(9))) end as parent_id,
          case when state = 'O' then 1 else 0 end as relevancy, case when discount > 0.01 then concat('c', cast(l_orderkey as varchar(20)), '-', cast(pos as varchar(9))) end as correct_csv,
          case when part % 5 = 0 then concat('text ', cast(part as varchar(20))) end as combined, case when supp % 11 = 0 then pos - (pos - 1) % 2 end as inter_head, pos % 2 as inter_level,
          case when supp % 2 = 0 then 1 else 0 end as headers_tagged, l_orderkey, pos, part, supp, quantity
        from spots""",
    "csvs": """
        select concat('c', cast(l_orderkey as varchar(20)), '-', cast(pos as varchar(9))) as csv_id, concat('t', cast(l_orderkey as varchar(20)), '-', cast(pos as varchar(9))) as table_id,
          case flag when 'A' then 'lattice-v' when 'N' then 'stream' else 'manual' end as method, cast(tax * 100 as int) % 3 as append_status,
          case when part % 3 > 0 then concat('raw ', cast(part as varchar(20))) end as csv_text, case when part % 4 > 0 then concat('done ', cast(part as varchar(20))) end as processed,
          case when tax > 0.01 then concat('ok ', cast(part as varchar(20))) end as accepted
        from spots""",
    "tags": "select cast(n_nationkey as int) as tag_id, concat('tag ', n_name) as tag_name from nation where n_nationkey between 1 and 15",
    "table_tags": """
        select table_id, 13 as tag_id from doc_tables where part % 3 = 0 union all select table_id, 1 from doc_tables where quantity > 40
        union all select table_id, 2 from doc_tables where supp % 7 = 0 union all select table_id, 3 from doc_tables where supp % 5 = 1
        union all select table_id, 4 from doc_tables where supp % 10 = 3 union all select table_id, 5 from doc_tables where part % 7 = 2
        union all select table_id, 6 from doc_tables where part % 13 = 4 union all select table_id, 12 from doc_tables where part % 17 = 5""",
    "headers": """
        select head_id as table_id, level - 1 as header_idx, concat('Header ', cast(part % 9 as varchar(9))) as title from doc_tables where headers_tagged = 1""",
    "htags": "select r_name as htag, r_regionkey + 1 as max_tags from region",
    "header_tags": """
        select h.table_id, h.header_idx, r.r_name as htag from headers h join region r on r.r_regionkey = (cast(substr(h.title, 8) as int) + h.header_idx) % 5""",
    "issues": """
        select t.table_id, x.n as row_index, concat('row ', cast(t.part as varchar(20)), case when t.part % 4 = 0 then ' VEC' else '' end) as content,
          case when t.part % 3 = 0 then 'Soils' when t.part % 3 = 1 then '' end as vec_pri, case t.supp % 4 when 0 then '-' when 1 then '?' when 2 then 'ESC' else 'erosion near crossing' end as issue_pri,
          case when t.supp % 3 = 0 then 'Resolved' when t.supp % 3 = 1 then 'unresolved' end as status, case t.part % 6 when 0 then 'Pasture' when 1 then 'Crop' when 2 then 'Bush' end as land_use,
          cast(t.part % 11 as double) / 11 as unres_prob, cast(t.part % 7 as double) / 7 as res_prob, case when t.supp % 5 > 0 then concat('SW-', cast(t.supp % 36 as varchar(9)), '-77-20-W5') end as loc_coord, case when t.supp % 6 = 0 then 'W5M' end as loc_mer
        from doc_tables t join (select r_regionkey + 1 as n from region where r_regionkey < 3) x on x.n <= t.quantity / 12 where t.level = 1""",
    "parsed": """
        select table_id, row_index, n as row_counter, concat(issue_pri, ' ', cast(n as varchar(9))) as issue_parsed, status, unres_prob, res_prob
        from issues join (select r_regionkey + 1 as n from region where r_regionkey < 2) y on n <= row_index""",
    "word_labels": "select table_id, row_index, cast(null as int) as row_counter, vec_pri as vec from issues where vec_pri <> '' union all select table_id, row_index, row_counter, 'Water' from parsed where row_index = 2",
    "sub_labels": "select table_id, row_index, row_counter, concat('sub ', issue_parsed) as sub_vec from parsed where status = 'Resolved'",
    "locations": """
        select i.table_id, i.row_index, 1 as loc_no, i.loc_coord as loc_text, case when length(i.loc_coord) > 14 then 'DLS' else 'NTS' end as loc_format from issues i where i.loc_coord is not null
        union all select i.table_id, i.row_index, 2, i.land_use, 'NTS2' from issues i where i.land_use is not null""",
    "land_use": "select table_id, row_index, loc_no, length(loc_text) % 4 as land_id from locations",
    "land_names": "select r_regionkey as land_id, lower(r_name) as nrcan, case when r_regionkey <> 2 then concat('sys ', r_name) end as sysops from region",
    "labels_list": "select r_name as vec, lower(substr(r_name, 1, 3)) as short_name, 5 - r_regionkey as test_order from region",
    "keywords": "select r.r_name as vec, lower(n.n_name) as phrase from nation n join region r on n.n_regionkey = r.r_regionkey",
}

#: How the facts are sent to be grouped.
SENT = "/*+ repartition(l_orderkey) */"
#: Bytes of the facts' files to a partition: some 500,000 rows, whose groups take well below 100 MB.
PART_BYTES = 1 << 23

#: The same rows in Spark's terms: sent once to be grouped and numbered; in one pass, not in one for each tag.
SPARK_VIEWS: dict[str, str] = {
    "captured": VIEWS["captured"].replace("from lineitem", f"from (select {SENT} * from lineitem)"),
    "table_tags": """
        select table_id, explode(filter(array(case when part % 3 = 0 then 13 end, case when quantity > 40 then 1 end, case when supp % 7 = 0 then 2 end, case when supp % 5 = 1 then 3 end,
          case when supp % 10 = 3 then 4 end, case when part % 7 = 2 then 5 end, case when part % 13 = 4 then 6 end, case when part % 17 = 5 then 12 end), x -> x is not null)) as tag_id
        from doc_tables""",
}


def for_spark(sql: str) -> str:
    """``sql`` with Spark's own text for the views that have one."""
    for name, own in SPARK_VIEWS.items():
        sql = sql.replace(VIEWS[name].strip(), own.strip())
    return sql


def parts_of(size: int, tasks: int) -> int | None:
    """Into how many partitions the facts, ``size`` bytes in files, are dealt; none: as many as Spark likes.

    Adaptive plans put partitions together until there is one for each of the
    ``tasks`` that run at a time, so what a task holds grows with the table,
    unless their number is given.
    """
    parts = -(-size // PART_BYTES)
    return parts if parts > tasks else None


def dealt(sql: str, parts: int | None) -> str:
    """``sql`` with its hints of repartition by a column for so many partitions."""
    return re.sub(r"(/\*\+ repartition\()(?=[a-z_]+\))", rf"\g<1>{parts}, ", sql) if parts else sql


def with_views(sql: str) -> str:
    """``sql`` with a WITH clause for the views it names, in order of definition."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\s+\w+\s+where", text):
                needed.add(name)
                need(VIEWS[name])

    need(sql)
    views = [f"{name} as ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    own = re.match(r"\s*with\s", sql)
    if not views:
        return sql
    return "with " + ",\n".join(views) + (",\n" + sql[own.end() :] if own else "\n" + sql)
