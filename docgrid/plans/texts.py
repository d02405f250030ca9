"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions import text as t
from docgrid.operators import nearest, phrases, similarity
from docgrid.plans.domain import with_views
from docgrid.plans.registry import register, table
from docgrid.plans.relational import run_sql

TOPICS = [("care", ["erest", "onthe?"]), ("land", ["thre", "and the"]), ("none", []), ("water", ["inor", "est", "that"])]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


@register("clean_text", r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\-'']+', ' ', 'g'), '\s+', ' ', 'g'))) as clean from documents", "F1 F3 F10")
def clean_text(s, d):
    return _docs(s, d).select("doc_id", F.md5(t.squeeze(t.classifier_text(F.col("text")))).alias("clean"))


@register("strip_html", r"select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) as txt from pages".replace('\\"', '"'), "F5 F6 S14")
def strip_html(s, d):
    return table(s, d, "pages").select("page_id", F.md5(t.html_text(F.col("html"))).alias("txt"))


@register("special_characters", r"select item_id, regexp_replace(text, '[^a-zA-Z\[\\\]^_`0-9\s]', ' ', 'g') as kept, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\[[^\]]*\]', '', 'g') as packed from benchmark", "F4 F5 F8")
def special_characters(s, d):
    b = table(s, d, "benchmark")
    return b.select("item_id", t.keep_alnum(F.col("text")).alias("kept"), t.strip_brackets(t.no_space(F.col("text"))).alias("packed"))


@register("tokenize", r"select doc_id, cast(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) between 2 and 15)) as int) as n from documents", "N4 N9 F2")
def tokenize(s, d):
    return _docs(s, d).select("doc_id", F.size(t.tokens(F.col("text"))).alias("n"))


@register("token_counts", r"select w, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) between 2 and 15)) as w from documents) x group by w", "N9 A18 F45")
def token_counts(s, d):
    return _docs(s, d).select(F.explode(t.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@register("stopwords", r"select item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) between 2 and 15 and not list_contains(['the', 'and', 'of', 'to', 'in', 'that', 'on', 'an', 'it', 'is', 'as', 'are', 'at', 'by', 'be', 'for', 'from', 'this', 'was', 'with'], w)), ' ') as kept from benchmark", "N5 N6")
def stopwords(s, d):
    few = ["the", "and", "of", "to", "in", "that", "on", "an", "it", "is", "as", "are", "at", "by", "be", "for", "from", "this", "was", "with"]
    return table(s, d, "benchmark").select("item_id", F.array_join(t.without(t.tokens(F.col("text")), few), " ").alias("kept"))


@register("normalise_corpora", None, "N1 N2 N3 N7 F7 F14 F15 F16")
def normalise_corpora(s, d):
    c = F.col("text")
    return table(s, d, "benchmark").select("item_id", t.normalise_a(c).alias("a"), t.normalise_b(c).alias("b"), t.normalise_c(c).alias("c"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) between 2 and 15)"


@register(
    "bigrams",
    f"""with w as (select doc_id, x.i as i, list_extract(ws, x.i) as a from (select doc_id, {_WORDS} as ws from documents) q, lateral (select unnest(range(1, len(ws) + 1)) as i) x),
    p as (select a, lead(a) over (partition by doc_id order by i) as b from w), c as (select a, count(*) as n from w group by a), v as (select count(*) as v from c)
    select p.a, p.b, count(*) as n, round((count(*) - 18) * max(v.v) / (max(ca.n) * max(cb.n) * 1.0), 4) as score from p join c ca on ca.a = p.a join c cb on cb.a = p.b cross join v where p.b is not null
    group by p.a, p.b having count(*) >= 18 and (count(*) - 18) * max(v.v) / (max(ca.n) * max(cb.n) * 1.0) > 16""",
    "N8",
)
def bigrams(s, d):
    return t.bigrams(_docs(s, d).select("doc_id", t.tokens(F.col("text")).alias("w")), "doc_id", "w", 18, 16).withColumn("score", F.round("score", 4))


def _first(texts: str) -> str:
    return "case " + " ".join(f"when regexp_matches({texts}, '\\b{p}\\b') then '{k}:{p}'" for k, ps in TOPICS for p in ps) + " else ':' end"


@register("keyword_first_match", f"select doc_id, {_first('c')} as hit from (select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9\\-'']+', ' ', 'g')) as c from documents) x", "X1 J17 F21 O9")
def keyword_first_match(s, d):
    hit = t.first_label([F.col("text")], TOPICS)
    return _docs(s, d).select("doc_id", hit.alias("h")).select("doc_id", F.concat_ws(":", "h.label", "h.phrase").alias("hit"))


def _many(texts: str) -> str:
    return "concat_ws(',', " + ", ".join("case when " + " or ".join(f"regexp_matches({texts}, '\\b{p}\\b')" for p in ps) + f" then '{k}' end" for k, ps in TOPICS if ps) + ")"


_SECOND = "lower(concat(coalesce(source, ''), ' in the minor ', coalesce(lang, '')))"


@register("keyword_multilabel", f"select doc_id, case when {_many('c')} <> '' then {_many('c')} else {_many('e')} end as labels from (select doc_id, {_SECOND} as e, trim(regexp_replace(lower(text), '[^a-z0-9\\-'']+', ' ', 'g')) as c from documents) x", "X4 X5 X6 X7 J17")
def keyword_multilabel(s, d):
    docs = table(s, d, "documents").select("doc_id", t.classifier_text(F.col("text")).alias("c"), F.expr(_SECOND).alias("e"))
    return docs.select("doc_id", F.array_join(t.labels(F.col("c"), F.col("e"), {k: v for k, v in TOPICS if v}), ",").alias("labels"))


@register("unclassified_queue", "select title, count(*) as n from (select concat(event_type, '-', cast(user_id % 7 as varchar)) as title, case when user_id % 3 = 0 then 'x' when user_id % 11 = 1 and user_id % 7 < 3 then 'generic' else '' end as label from events) x where label = '' and title not in (select concat(event_type, '-', cast(user_id % 7 as varchar)) from events where user_id % 3 <> 0 and user_id % 11 = 1 and user_id % 7 < 3 and event_type is not null) group by title", "X2")
def unclassified_queue(s, d):
    user = F.col("user_id")
    label = F.when(user % 3 == 0, "x").when((user % 11 == 1) & (user % 7 < 3), "generic").otherwise("")
    rows = table(s, d, "events").select(F.concat("event_type", F.lit("-"), user % 7).alias("title"), label.alias("label"))
    return t.unclassified(rows, "label", "title")


@register("dictionary_backup", with_views("select distinct vec as label, phrase from keywords"), "X3")
def dictionary_backup(s, d):
    """A dictionary written as JSON lists and restored."""
    return t.dictionary_from_json(t.dictionary_to_json(run_sql(s, d, with_views("select vec as label, phrase from keywords"))))


@register(
    "odd_one_out",
    """with u as (select vec_id % 50 as g, vec_id, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[])))) as v from embeddings),
    e as (select g, vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from u), m as (select g, i, avg(x) as m from e group by g, i),
    s as (select e.g, vec_id, round(sum(x * m), 9) as s from e join m on m.g = e.g and m.i = e.i group by e.g, vec_id)
    select g, vec_id from s qualify row_number() over (partition by g order by s, vec_id) = 1""",
    "N12",
)
def odd_one_out(s, d):
    return t.odd_one_out(table(s, d, "embeddings").withColumn("g", F.col("vec_id") % 50), "g")


@register("name_in_text", "select d.doc_id, b.lang as name from documents d join (select distinct lang from documents) b on contains(lower(d.text), b.lang)", "J18")
def name_in_text(s, d):
    docs = table(s, d, "documents")
    return phrases.phrase_hits(docs.select("doc_id", F.lower("text").alias("low")), docs, "doc_id", "low", "lang", bounds=False).select("doc_id", F.col("phrase").alias("name"))


_CLEAN = "trim(regexp_replace(lower(text), '[^a-z0-9\\-'']+', ' ', 'g'))"
#: A dictionary as large as the table: the first two words of each turn, labelled by who spoke.
_OPENINGS = f"(select distinct role as label, regexp_extract({_CLEAN}, '^[a-z0-9]+ [a-z0-9]+') as phrase from conversations) o where phrase <> ''"


@register("openings_in_text", f"with c as (select doc_id, {_CLEAN} as c from documents) select distinct doc_id, phrase from c join (select * from {_OPENINGS}) o on contains(c, phrase) and regexp_matches(c, '\\b' || phrase || '\\b')", "J17 F21")
def openings_in_text(s, d):
    """Which openings of a turn stand in which documents."""
    return phrases.phrase_hits(_cleaned(s, d), _openings(s, d), "doc_id", "c").select("doc_id", "phrase")


@register("openings_first_label", f"with c as (select doc_id, {_CLEAN} as c from documents) select doc_id, label, phrase from c join (select * from {_OPENINGS}) o on contains(c, phrase) and regexp_matches(c, '\\b' || phrase || '\\b') qualify row_number() over (partition by doc_id order by label, phrase) = 1", "X1 J17 O9")
def openings_first_label(s, d):
    """Of a document's openings the first by label, then phrase."""
    return phrases.first_hits(_cleaned(s, d), _openings(s, d), "doc_id", "c")


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", t.classifier_text(F.col("text")).alias("c"))


def _openings(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations")
    return turns.select(F.col("role").alias("label"), F.regexp_extract(t.classifier_text(F.col("text")), "^[a-z0-9]+ [a-z0-9]+", 0).alias("phrase")).where("phrase <> ''").distinct()


@register("status_norm", r"select event_id, case when regexp_matches(x, '\bno issues\b') then 'Resolved' when regexp_matches(x, '\b(unresolved|u)\b') then 'Unresolved' when regexp_matches(x, '\b(resolved|r|no issue)\b') then 'Resolved' else y end as status from (select event_id, lower(y) as x, y from (select event_id, case user_id % 5 when 0 then 'No issues' when 1 then 'U - open' when 2 then 'R (closed)' when 3 then 'Unresolved r' else event_type end as y from events) a) b", "F47 P9")
def status_norm(s, d):
    k = F.col("user_id") % 5
    y = F.when(k == 0, "No issues").when(k == 1, "U - open").when(k == 2, "R (closed)").when(k == 3, "Unresolved r").otherwise(F.col("event_type"))
    return table(s, d, "events").select("event_id", t.status_of(y).alias("status"))


@register("json_props", "select event_id, cast(json_extract(props, '$.k') as int) as k from events", "F27 S24 S13")
def json_props(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("number_formats", r"select p_partkey, cast(regexp_extract(concat(p_brand, ''), '(\d+)$', 1) as int) as tail, floor(p_retailprice * 5000 / 1048576 * 100) / 100 as mb, printf('%03d%s%02d', p_size, 'K', p_size % 7) as code, greatest(p_size, 10) as high, least(p_size, 10) as low from part", "F18 F23 F32 F35 F26")
def number_formats(s, d):
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", t.trailing_number(F.col("p_brand")).alias("tail"), t.megabytes(F.col("p_retailprice") * 5000).alias("mb"), F.format_string("%03d%s%02d", size, F.lit("K"), size % 7).alias("code"), F.greatest(size, F.lit(10)).alias("high"), F.least(size, F.lit(10)).alias("low"))


@register("issue_split", None, "X11 X12 F30 S24")
def issue_split(s, d):
    c = table(s, d, "conversations").withColumn("text", F.concat(F.lit("Sept 17, 2016 - seen. "), F.regexp_replace("text", r"\n", " - ")))
    return c.select("conv_id", "turn", F.posexplode(t.split_issues(F.col("text"))).alias("part", "issue"))


@register("fuzzy_pairs", None, "F22 J16 X14")
def fuzzy_pairs(s, d):
    return similarity.similar_pairs(table(s, d, "benchmark"), "item_id", "text", 40, similarity.FUZZY)


_SCORE = "cast(round(100 * (1 - cast(levenshtein(a.x, b.x) as double) / greatest(length(a.x), length(b.x), 1))) as int)"


def _edit_sql(rows: str, least: int) -> str:
    return f"with t as ({rows}) select a.k as a, b.k as b, {_SCORE} as score from t a join t b on a.k < b.k and 100 * least(length(a.x), length(b.x)) >= {least - 1} * greatest(length(a.x), length(b.x)) where {_SCORE} >= {least}"


@register("levenshtein_pairs", _edit_sql("select item_id as k, regexp_replace(text, '[^ -~]', '?', 'g') as x from benchmark", 25), "F22 J16")
def levenshtein_pairs(s, d):
    plain = table(s, d, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("x"))
    return similarity.similar_pairs(plain, "item_id", "x", 25)


@register("near_names", _edit_sql("select p_partkey as k, concat(p_name, ' ', lower(p_type), ' ', p_brand) as x from part", 90), "J16 F22 X14")
def near_names(s, d):
    """Parts whose names, types and brands differ by a few characters."""
    return similarity.similar_pairs(table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand").alias("x")), "p_partkey", "x", 90)


@register("cosine_topk", "select q.vec_id as q, e.vec_id as id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 5) as similarity, cast(row_number() over (partition by q.vec_id order by list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) desc, e.vec_id) as int) as place from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0 qualify place <= 18", "N11 N12 O6")
def cosine_topk(s, d):
    e = table(s, d, "embeddings")
    return nearest.cosine_top(e, e.where("vec_id % 100 = 0"), 18).withColumn("similarity", F.round("similarity", 5))


@register("similarity_cache", "select q.vec_id as q, e.vec_id as id, cast(row_number() over (partition by q.vec_id order by list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) desc, e.vec_id) as int) as place from embeddings q join embeddings e on q.vec_id <> e.vec_id qualify place <= 3", "N16 O6")
def similarity_cache(s, d):
    return nearest.SimilarityCache(table(s, d, "embeddings"), 3).of().select("q", "id", "place")


@register("dictionary_curation", with_views("select distinct * from (select case vec when 'ASIA' then 'EUROPE' else vec end as label, phrase from keywords union all select 'AFRICA', 'kenya' union all select 'NEW', 'fresh') x where not (label = 'EUROPE' and phrase = 'nation_7')"), "U5 X8")
def dictionary_curation(s, d):
    words = run_sql(s, d, with_views("select vec as label, phrase from keywords"))
    return t.curate(words, {"ASIA": "EUROPE"}, {"AFRICA": ["kenya"], "NEW": ["fresh"]}, {"EUROPE": ["nation_7"]})


@register("context_pairs", None, "N13")
def context_pairs(s, d):
    return t.context_pairs(table(s, d, "benchmark").select("item_id", t.tokens(F.col("text")).alias("w")), "item_id", "w", 2)


@register("word2vec_synonyms", None, "N10 N11 O6")
def word2vec_synonyms(s, d):
    """The 18 nearest of the most frequent word (a top-k report)."""
    docs = _docs(s, d).select(t.tokens(F.col("text")).alias("w"))
    model = t.train_embeddings(docs, "w", size=16, window=5, iterations=1)
    word = docs.select(F.explode("w").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").first()
    return model.findSynonyms(word.w, 18) if word else s.createDataFrame([], "word string, similarity double")


@register("merged_labels", "select d.doc_id, l.quality, l.toxic, case when l.quality is null then 'none' when l.quality = 1 then 'good' else 'poor' end as status from documents d left join labels l on l.doc_id = d.doc_id", "X13 P10 P16")
def merged_labels(s, d):
    j = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    return j.withColumn("status", F.when(F.col("quality").isNull(), "none").when(F.col("quality") == 1, "good").otherwise("poor"))
