"""Queries of the location and layout functions; places are made from the captured lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.functions import places as p
from docgrid.operators import layout
from docgrid.operators.companies import writing_companies as resolve
from docgrid.plans import store
from docgrid.plans.domain import with_views
from docgrid.plans.registry import register, table
from docgrid.plans.relational import parts, run_sql, spread
from docgrid.shared import written

_PARTS = "select table_id, part % 16 + 1 as lsd, supp % 36 + 1 as section, part % 126 + 1 as township, supp % 34 + 1 as rng, part % 6 + 1 as meridian from doc_tables"


def _parts(s, d):
    return run_sql(s, d, with_views(_PARTS))


def _sql(text: str) -> str:
    return with_views(f"with parts as ({_PARTS}) {text}")


#: The fixed patterns don't know LSD 10: a survey place is read without it, a map sheet as 1.
@register("dls_parse", _sql("select table_id, concat(case when lsd <> 10 then concat(cast(lsd as varchar), '-') else '' end, cast(section as varchar), '-', cast(township as varchar), '-', cast(rng as varchar), '-W', cast(meridian as varchar), 'M') as place from parts"), "L5 F20 F19")
def dls_parse(s, d):
    c = _parts(s, d).withColumn("t", F.format_string("at %02d- %d-%d-%d W%dM now", "lsd", "section", "township", "rng", "meridian"))
    return c.select("table_id", F.get(p.dls(F.col("t")), F.lit(0))["text"].alias("place"))


@register(
    "dls_to_latlong",
    _sql(
        """select table_id, round(n, 6) as n, round(z + degrees((west + 0.125) / (3958.8 * cos(radians(n)))), 6) as w from (
          select *, 49 + degrees((north + 0.125) / 3958.8) as n from (select table_id, case when meridian = 1 then 97.45789e0 else 4e0 * (meridian - 1) + 98 end as z,
            6e0 * (township - 1) + (section - 1) / 6e0 + (lsd - 1) / 4e0 * 0.25 as north,
            6e0 * (rng - 1) + case when (section - 1) % 12 = 0 then (section - 1) % 6 else 5 - (section - 1) % 6 end + 0.25 * case when (lsd - 1) % 8 = 0 then (lsd - 1) % 4 else 3 - (lsd - 1) % 4 end as west from parts) a) b"""
    ),
    "L8 F36",
)
def dls_to_latlong(s, d):
    c = _parts(s, d)
    at = p.dls_to_lat_long(F.col("lsd").cast("string"), F.col("section"), F.col("township"), F.col("rng"), F.col("meridian").cast("string"))
    return c.select("table_id", at.alias("at")).select("table_id", F.round("at.n", 6).alias("n"), F.round("at.w", 6).alias("w"))


@register("nts_parse", _sql("select table_id, concat(chr(cast(97 + lsd % 4 as int)), '-', cast(township % 100 + 1 as varchar), '-', chr(cast(65 + rng % 12 as int)), '/', cast(80 + section % 20 as varchar), '-', chr(cast(65 + lsd % 16 as int)), '-', cast(case when lsd = 10 then 1 else lsd end as varchar)) as place from parts"), "L6 L9 F23")
def nts_parse(s, d):
    letter = lambda a, k, n: F.char(F.lit(a) + F.col(k) % n)
    t = F.format_string("%s-%d-%s/%d-%s-%d.", letter(97, "lsd", 4), F.col("township") % 100 + 1, letter(65, "rng", 12), F.col("section") % 20 + 80, letter(65, "lsd", 16), F.col("lsd"))
    return _parts(s, d).select("table_id", F.get(p.nts(t), F.lit(0))["text"].alias("place"))


@register("mlv_parse", _sql("select table_id, concat('MLV ', cast(section as varchar), ' + ', cast(rng as varchar), '.', cast(lsd as varchar), 'km') as place from parts"), "L7")
def mlv_parse(s, d):
    return _parts(s, d).select("table_id", F.get(p.mlv(F.format_string("near MLV %d + %d.%dkm x", "section", "rng", "lsd")), F.lit(0)).alias("place"))


@register("latlong_parse", _sql("select table_id, round(township / 2 + 0.25e0, 4) as n, round(rng + 90.5e0, 4) as w from (select table_id, cast(floor(township / 2.0) as double) as half, township, rng from parts) x".replace("round(township / 2 + 0.25e0, 4)", "round(half + 0.25e0, 4)")), "L1 L2 L3 L4 W12 F34 F37")
def latlong_parse(s, d):
    t = F.concat(F.floor(F.col("township") / 2).cast("string"), F.lit(".25 N, "), F.col("rng").cast("int") + 90, F.lit(".5 W."))
    return _parts(s, d).select("table_id", F.get(p.lat_longs(t), F.lit(0)).alias("at")).select("table_id", F.round("at.n", 4).alias("n"), F.round("at.w", 4).alias("w"))


_Q, _TO = "case supp % 4 when 0 then 'NW' when 1 then 'NE' when 2 then 'SW' else 'SE' end", "section % 30 + 1"


@register(
    "location_ranges",
    _sql(
        f""", sheets as (select *, case when lsd = 10 then 1 else lsd end as sheet from parts) select table_id, 1 as no, case when k = 2 then 'NTS' else 'DLS' end as format, case when k = 2 then concat('b-', rng, '-J/', township, '-I-', sheet) else concat('SW-', section, '-', township, '-', rng, '-W', meridian, 'M') end as start,
          case when k = 1 then concat('NE-', {_TO}, '-', township, '-', rng, '-W', meridian, 'M') when k = 2 and lsd % 3 = 0 then concat('C-', section, '-A/', rng, '-P-', sheet) end as "end", false as check from (select *, lsd % 4 as k from sheets) a where k < 3
        union all select table_id, 2, 'NTS', concat('C-', section, '-A/', rng, '-P-', sheet), null, false from sheets where lsd % 4 = 2 and lsd % 3 <> 0
        union all select table_id, 1, 'NTS2', concat('NA-E-', section, '/', rng, '-I-', lsd), null, false from parts where lsd % 4 = 3"""
    ),
    "L10 L11",
)
def location_ranges(s, d):
    k, c = F.col("lsd") % 4, F.col
    survey = F.format_string("SW 1/4 Sec %d-%d-%d-W%d", "section", "township", "rng", "meridian")
    text = (
        F.when(k == 0, survey)
        .when(k == 1, F.concat(survey, F.format_string(" to NE-%d-%d-%d-W%d", c("section") % 30 + 1, c("township"), c("rng"), c("meridian"))))
        .when(k == 2, F.concat(F.format_string("b-%03d-J/%d-I-%02d", "rng", "township", "lsd"), F.when(c("lsd") % 3 == 0, " : ").otherwise(" and so it goes "), F.format_string("C-%d-A/%d-P-%d", "section", "rng", "lsd")))
        .otherwise(F.format_string("%dI-%02d-E%d", "rng", "lsd", "section"))
    )
    found = _parts(s, d).select("table_id", F.explode(p.extract_places(text, F.lit("W5M"))).alias("x"))
    return found.select("table_id", "x.*")


@register("location_histogram", with_views("select loc_format as doc, loc_text as txt, count(*) as n, string_agg(cast(loc_no as varchar), ',' order by loc_no) as pages from locations group by 1, 2"), "L12 A20 K18")
def location_histogram(s, d):
    loc = run_sql(s, d, with_views("select * from locations"))
    out = p.histogram(loc, "loc_format", "loc_text", "loc_no")
    return out.select(F.col("loc_format").alias("doc"), F.col("loc_text").alias("txt"), "n", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@register("caption_labels", r"select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then 'table' when l_linenumber % 3 = 1 then 'figure' end as kind, case when l_linenumber % 3 = 0 then concat(cast(l_linenumber as varchar), '.', cast(l_partkey as varchar)) when l_linenumber % 3 = 1 then concat('B-', cast(l_suppkey as varchar)) end as id from lineitem", "H1 H5")
def caption_labels(s, d):
    n = F.col("l_linenumber")
    line = F.when(n % 3 == 0, F.concat(F.lit("Table "), n, F.lit("."), F.col("l_partkey"), F.lit(": soils"))).when(n % 3 == 1, F.concat(F.lit("FIGURE B-"), F.col("l_suppkey"))).otherwise("table of contents")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", p.heading(line).alias("h")).select("l_orderkey", "l_linenumber", "h.kind", "h.id")


_TURNS = "concat(case turn % 4 when 0 then 'a Table' when 1 then 'of Figures' when 2 then 'Photo...' else 'TABLE OF CONTENTS' end, ' ', cast(turn as varchar(9)), chr(10), role)"


@register("caption_lines", f"select conv_id, turn, replace(nxt, chr(10), ' ') as following from (select *, lead({_TURNS}) over (partition by conv_id order by turn) as nxt from conversations) c where turn % 4 < 2", "L13 W10")
def caption_lines(s, d):
    lines = table(s, d, "conversations").select("conv_id", F.floor(F.col("turn") / 3).alias("page"), "turn", F.expr(_TURNS.replace("varchar(9)", "string")).alias("t"))
    return p.captions(lines, "conv_id", "page", "turn", "t").select("conv_id", "turn", "following")


#: Pages with many short lines; some have leaders, some a title, most lines of some end in a number.
_CONTENTS = """
    select l_orderkey // 40 as doc_id, l_orderkey // 8 % 5 as page, case when part % 97 = 0 then 'List of Tables' when part % 41 = 0 then 'Soils ......... 12' when l_orderkey // 8 % 2 = 0 and supp % 3 > 0 then concat('Soils ', cast(part as varchar(9))) when supp % 7 = 0 then '  ' else 'end of line. ' end as text
    from captured"""


@register(
    "toc_pages",
    with_views(
        f"""with l as (select doc_id, page, trim(lower(text)) as t from ({_CONTENTS}) z), g as (select doc_id, page, bool_or(t <> '' and (contains(t, 'list of tables') or (length(t) - length(regexp_replace(t, '\\.{{2,}}', '', 'g'))) > 0.3 * length(t))) as sure, count(*) as n, count(case when regexp_matches(t, '[0-9]$') then 1 end) as ends from l group by doc_id, page),
        b as (select *, page - row_number() over (partition by doc_id order by page) as gap from g where (sure or (n > 10 and ends > 0.3 * n)) and page >= (select min(x.page) from g x where x.doc_id = g.doc_id and x.sure))
        select doc_id, page from b where gap = (select min(c.gap) from b c where c.doc_id = b.doc_id)"""
    ),
    "H2 W9",
)
def toc_pages(s, d):
    return p.contents_pages(run_sql(s, d, with_views(_CONTENTS).replace("//", "div")), "doc_id", "page", "text")


@register("outline_rows", with_views("select pdf_name as doc_id, table_id as title, page, level - 1 as level, row_number() over (partition by pdf_name order by pos) as place from doc_tables"), "S19")
def outline_rows(s, d):
    """Chains of tables as an outline: a chain's head on top, each page below the one before."""
    nodes = run_sql(s, d, with_views("select pdf_name as doc_id, table_id as node, parent_id as parent, pos as position, table_id as title, page from doc_tables"))
    return p.outline_rows(nodes)


_BOX = "select l_orderkey as image_id, l_linenumber as n, cast(l_partkey % 50 as double) as x, cast(l_suppkey % 40 as double) as y, cast(l_quantity as double) as w, cast(l_quantity / 2 as double) as h from lineitem"


@register("bbox_overlap", f"with b as ({_BOX}) select a.image_id, count(*) as n from b a join b c on a.image_id = c.image_id and a.n < c.n where a.x <= c.x + c.w and c.x <= a.x + a.w and a.y <= c.y + c.h and c.y <= a.y + a.h group by a.image_id", "F38")
def bbox_overlap(s, d):
    b = run_sql(s, d, _BOX).select("image_id", "n", F.struct("x", "y", "w", "h").alias("box"))
    other = b.select("image_id", F.col("n").alias("m"), F.col("box").alias("other"))
    return b.join(other, "image_id").where("n < m").where(p.overlaps(F.col("box"), F.col("other"))).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    "bbox_merge",
    f"""with recursive b as (select row_number() over () as id, * from ({_BOX}) z), o as (select a.image_id, a.id as i, c.id as j from b a join b c on a.image_id = c.image_id and a.x <= c.x + c.w and c.x <= a.x + a.w and a.y <= c.y + c.h and c.y <= a.y + a.h),
    r as (select image_id, i, j from o union select r.image_id, r.i, o.j from r join o on o.i = r.j), g as (select i, min(j) as c from r group by i),
    m as (select image_id, c, min(x) as x, min(y) as y, max(x + w) as x1, max(y + h) as y1 from b join g on g.i = b.id group by image_id, c)
    select image_id, x, y, x1 - x as w, y1 - y as h from m where not exists (select 1 from m n where n.image_id = m.image_id and n.c <> m.c and n.x <= m.x and n.y <= m.y and n.x1 >= m.x1 and n.y1 >= m.y1)""",
    "F39",
)
def bbox_merge(s, d):
    return layout.merge_boxes(run_sql(s, d, _BOX).select("image_id", "x", "y", "w", "h"))


_PICTURES = "select o_orderkey as image_id, 900 as w, 700 as h from orders"


@register(
    "picture_parts",
    f"""with recursive b as (select row_number() over () as id, image_id // 3 as image_id, x, y, w, h, count(*) over (partition by image_id // 3) as n from ({_BOX}) z),
    k as (select * from b where n < 10 and w > 20 and h > 20), o as (select a.id as i, c.id as j from k a join k c on a.image_id = c.image_id and a.x <= c.x + c.w and c.x <= a.x + a.w and a.y <= c.y + c.h and c.y <= a.y + a.h),
    r as (select i, j from o union select r.i, o.j from r join o on o.i = r.j), g as (select i, min(j) as c from r group by i),
    m as (select image_id, c, min(x) as x, min(y) as y, max(x + w) as x1, max(y + h) as y1 from k join g on g.i = k.id group by image_id, c)
    select image_id, x, y, x1 - x as w, y1 - y as h from m where not exists (select 1 from m n where n.image_id = m.image_id and n.c <> m.c and n.x <= m.x and n.y <= m.y and n.x1 >= m.x1 and n.y1 >= m.y1)
    union all select image_id, 0.0, 0.0, 900.0, 700.0 from (select distinct image_id from b where n >= 10) x join (select o_orderkey from orders) q on q.o_orderkey = x.image_id""",
    "H7",
)
def picture_parts(s, d):
    boxes = run_sql(s, d, _BOX).select(F.floor(F.col("image_id") / 3).alias("image_id"), "x", "y", "w", "h")
    return layout.picture_parts(boxes, run_sql(s, d, _PICTURES))


#: Pages of lines made from the captured tables: labels, leaders, text between, raised signs.
_LINES = """
    select l_orderkey // 40 as doc_id, l_orderkey // 8 % 5 as page, l_orderkey * 10 + l_linenumber as line, case part % 9 when 0 then concat('Table ', cast(part % 20 as varchar(9)), ' Soils of') when 1 then 'erosion, wind'
      when 2 then concat('continued ..... ', cast(part % 90 as varchar(9))) when 3 then concat('Figure ', cast(part % 7 as varchar(9)), '.', cast(supp % 3 as varchar(9)), ': Map ........ ', cast(supp % 80 as varchar(9)))
      when 4 then 'plain text' when 5 then 'Appendix B List' when 6 then '12' when 7 then 'see Table 4' end as text, cast(supp % 4 as double) / 4 + 10 as height from captured"""


def _lines(s, d):
    return run_sql(s, d, with_views(_LINES).replace("//", "div"))


_ROWS = f"""with l as ({_LINES}), m as (select doc_id, page, line, coalesce(text, '') as t, regexp_matches(coalesce(text, ''), '\\.{{2,}}') as d, regexp_matches(coalesce(text, ''), '{p.LABEL}') as b from l),
    s as (select *, coalesce(max(case when b and not d then line end) over w, -1) > coalesce(max(case when d then line end) over w, -1) as o from m window w as (partition by doc_id, page order by line rows between unbounded preceding and 1 preceding)),
    k as (select *, sum(case when d and not o or b and not d then 1 else 0 end) over (partition by doc_id, page order by line) as r from s where d or b or o),
    rows_ as (select doc_id, page, r as row, string_agg(t, ' ' order by line) as text from k group by doc_id, page, r)"""


@register("contents_rows", with_views(_ROWS + " select doc_id, page, cast(row as bigint) as row, text from rows_"), "H3")
def contents_rows(s, d):
    return layout.contents_rows(_lines(s, d))


@register(
    "contents_labels",
    with_views(
        _ROWS
        + f""" select doc_id, label, title, shown_page from (select doc_id, page, row, concat(lower(regexp_extract(text, '{p.LABEL}', 2)), lower(coalesce(nullif(regexp_extract(text, '{p.LABEL}', 3), ''), regexp_extract(text, '{p.LABEL}', 4)))) as label,
        trim(regexp_replace(split_part(text, regexp_extract(text, '{p.LABEL}', 1), 2), '(?:\\.{{2,}})+.*', '')) as title, try_cast(nullif(regexp_extract(text, '\\.{{2,}}\\s*(\\d+)\\s*$', 1), '') as int) as shown_page
        from rows_ where regexp_matches(text, '{p.LABEL}')) x qualify row_number() over (partition by doc_id, label order by page desc, row desc) = 1"""
    ),
    "H3",
)
def contents_labels(s, d):
    return layout.contents_labels(layout.contents_rows(_lines(s, d)))


@register(
    "captions_whole",
    with_views(
        f"""with l as ({_LINES}), m as (select doc_id, page, line, coalesce(text, '') as t, height, max(case when regexp_matches(coalesce(text, ''), '^(?:{p.LABEL})') then line end) over (partition by doc_id, page order by line) as head from l),
        n as (select a.*, length(a.t) > 3 and a.height <> b.height as x from m a join m b on b.doc_id = a.doc_id and b.page = a.page and b.line = a.head)
        select doc_id, page, head as line, trim(string_agg(t, ' ' order by line)) as text, count(*) as lines from n where line < coalesce((select min(z.line) from n z where z.doc_id = n.doc_id and z.page = n.page and z.head = n.head and z.x), line + 1) group by doc_id, page, head"""
    ),
    "H5 W11",
)
def captions_whole(s, d):
    return layout.captions(_lines(s, d))


@register("tagged_pictures", None, "H6")
def tagged_pictures(s, d):
    """Pictures of the pages with their captions; boxes, captions and large writing all come from the captured tables."""
    lines = spread(store.query(s, d, _LINES.replace("//", "div"), {"captured"}), d, "doc_id", "page")
    label = layout.captions(lines).withColumn("cx", F.lit(200.0) + F.col("line") % 5).withColumn("cy", (F.col("line") % 700).cast("double")).withColumn("label", F.col("line"))
    spots = store.query(s, d, "select l_orderkey div 40 as doc_id, l_orderkey div 8 % 5 as page, l_orderkey * 10 + l_linenumber as image, cast(supp % 300 as double) as x, cast(part % 600 as double) as y, case when part % 11 = 0 then 600.0 else cast(100 + supp % 9 as double) end as w, case when part % 11 = 0 then 790.0 else 80.0 end as h, part % 3 = 0 as is_table from captured where part % 4 = 1", {"captured"})
    writing = lines.select("*", F.lit(50.0).alias("y"), (F.col("height") + F.col("line") % 3).alias("font"))
    return layout.tag_images(spread(spots, d, "doc_id", "page").withColumns({"page_w": F.lit(612.0), "page_h": F.lit(792.0)}), label, layout.contents_labels(layout.contents_rows(lines)), writing, parts(s, d))


_PAGES = """select concat('p', cast(l_orderkey as varchar(20))) as pdf_id, pos - 1 as page, case when part % 11 = 0 then '' when part % 13 = 0 then cast(null as varchar(9)) else concat(case part % 4 when 0 then 'Table  of Contents, ' when 1 then 'RE: ' else 'report ' end,
      case when supp % 9 = 0 then concat('by SUPPLIER#', lpad(cast(supp as varchar(9)), 9, '0'), '!') when supp % 8 = 1 then concat('supplier ', lpad(cast(supp as varchar(9)), 9, '0'), ' Ltd') else 'nobody' end) end as text from spots"""
_NAMES = "select case when s_suppkey % 2 = 0 then s_name else replace(s_name, '#', ' ') end as name from supplier"
_FORCED, _FRONT = {5: ["Zeta", "Alpha"], 17: []}, {"p7": ["Front"]}


@register(
    "writing_companies",
    with_views(
        f"""with g as ({_PAGES}), n as (select distinct name from ({_NAMES}) z), d as (select pdf_name, filing_id, company from pdfs),
        f as (select d.filing_id, list(distinct n.name order by n.name) as found from d join g on g.pdf_id = d.pdf_name and g.page = 0 join n on contains(replace(lower(g.text), chr(10) || chr(10), ' '), lower(n.name)) group by d.filing_id),
        a as (select d.*, case d.filing_id when 5 then ['Alpha', 'Zeta'] when 17 then [] else f.found end as n2 from d left join f using (filing_id)),
        w as (select pdf_id, trim(regexp_replace(string_agg(lower(coalesce(text, '')), '' order by page), '[^a-zA-Z0-9\\-&]+', ' ', 'g')) as whole, max(case when page = 1 then coalesce(text, '') end) as p1, max(case when page = 2 then coalesce(text, '') end) as p2 from g group by pdf_id),
        k as (select pdf_id, third, trim(regexp_replace(lower(coalesce(case when third then p2 else p1 end, '')), '[^a-zA-Z0-9\\-&]+', ' ', 'g')) as t from (select *, not contains(whole, 'table of contents') or coalesce(p1, '') = '' as third from w) x),
        h as (select k.pdf_id, k.third, list(distinct n.name order by n.name) as n3 from k join n on contains(k.t, lower(n.name)) group by k.pdf_id, k.third)
        select a.pdf_name as pdf_id, case when a.pdf_name = 'p7' then 'prefix' when len(n2) > 0 and a.filing_id in (5, 17) then 'filing' when len(n2) > 0 then 'page 1' when h.n3 is null then 'own' when h.third then 'page 3' else 'page 2' end as step,
          array_to_string(case when a.pdf_name = 'p7' then ['Front'] when len(n2) > 0 then n2 else coalesce(h.n3, ['In-house Consulting: ' || coalesce(a.company, '')]) end, '; ') as companies
        from a left join h on h.pdf_id = a.pdf_name"""
    ),
    "X9 J18 A15 K8",
)
def writing_companies(s, d):
    pdfs = run_sql(s, d, with_views("select pdf_name as pdf_id, pdf_name, filing_id, company from pdfs"))
    pages, _ = written(run_sql(s, d, with_views(_PAGES)), "pages")  # read twice; these columns need no strings of the facts
    return resolve(pdfs, pages, run_sql(s, d, _NAMES), _FORCED, _FRONT, joined="; ")


@register("bbox_arithmetic", f"with b as ({_BOX}) select image_id, n, least(x, w) as x1, greatest(x, w) as x2, cast(trunc(x * 612 / 1700) as int) as points, sqrt(power(x - w, 2) + power(y - h, 2)) as far, round(x * 612 / 1700, 6) as cx, round(792 - (y + h) * 792 / 2200, 6) as cy from b", "F36 F38 F40 F42 F43")
def bbox_arithmetic(s, d):
    c = F.col
    r = p.rectangle(c("x"), c("y"), c("w"), c("h"))
    at = p.from_canvas(c("x"), c("y"), c("w"), c("h"), F.lit(1700.0), F.lit(2200.0), F.lit(612.0), F.lit(792.0))
    far = F.sqrt(F.pow(c("x") - c("w"), F.lit(2)) + F.pow(c("y") - c("h"), F.lit(2)))
    return run_sql(s, d, _BOX).select("image_id", "n", r["x1"].alias("x1"), r["x2"].alias("x2"), p.to_points(c("x"), F.lit(612), F.lit(1700)).alias("points"), far.alias("far"), F.round(at["x"], 6).alias("cx"), F.round(at["y"], 6).alias("cy"))


@register("nearest_labels", f"with b as ({_BOX}) select image_id, n, min_by(label, (far, label)) as label from (select a.image_id, a.n, a.x, a.y, c.n as label, sqrt(power(a.x - c.x, 2) + power(a.y - c.y, 2)) as far from (select distinct image_id, n, x, y from b where n % 2 = 0) a join b c on c.image_id = a.image_id and c.n % 2 = 1) z group by image_id, n, x, y", "O8 H6")
def nearest_labels(s, d):
    b = run_sql(s, d, _BOX)
    items = b.where("n % 2 = 0").select("image_id", "n", "x", "y").distinct()
    return p.nearest_label(items, b.where("n % 2 = 1").select("image_id", F.col("n").alias("label"), "x", "y"), "image_id").select("image_id", "n", "label")


@register("straight_lines", "select image_id, round(sum(case when dx = 0 or dy = 0 then dx + dy else 0 end) / sum(dx + dy), 6) as share from (select l_orderkey as image_id, cast(l_partkey % 3 as double) as dx, cast(l_suppkey % 2 + 1 as double) as dy from lineitem) x group by image_id", "F48")
def straight_lines(s, d):
    l = table(s, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.lit(0.0).alias("x1"), (F.col("l_partkey") % 3).cast("double").alias("x2"), F.lit(0.0).alias("y1"), (F.col("l_suppkey") % 2 + 1).cast("double").alias("y2"))
    return p.straight_share(l, "image_id").select("image_id", F.round("share", 6).alias("share"))
