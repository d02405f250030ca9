"""URL filter with redirect equivalence, DataFrame functions only.

Rules on (host, path prefix) decide a url directly. Pages that redirect to, or
name as canonical, another url are aliases: the connected components over
these edges carry a block decision from any member to those members that no
rule decides, unless the component holds an explicitly allowed member.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.components import components

Rule = tuple[str, str, str]


#: The letters that hosts and schemes are written in.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without '://' or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.when(at > 0, host).otherwise(""), F.when(at > 0, path).otherwise("")


#: Scheme, host with port, path, query of a whole url.
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_node(url: Column) -> Column:
    """The url by which a page is known: scheme and host in lower case, no default port, no fragment, '/' for no path."""
    part = lambda k: F.regexp_extract(url, _PARTS, k)
    scheme, host = F.translate(part(1), _UPPER, _LOWER), F.translate(part(2), _UPPER, _LOWER)
    host = F.when(scheme == "http", F.regexp_replace(host, r":(80)?\z", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?\z", "")).otherwise(host)
    whole = F.concat(scheme, F.lit("://"), host, F.when(part(3) == "", "/").otherwise(part(3)), part(4))
    return F.when(url.rlike(_PARTS), whole).otherwise(F.regexp_replace(url, r"(?s)#.*", ""))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.

    Longer means more characters of host and path together; of equally long
    rules an allow goes first. A rule's host fits itself and its subdomains.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the last one set wins: short before long, block before allow
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_targets(html: Column) -> Column:
    """The urls that a page's html names as canonical and that it refreshes to, as written; one or both may be missing."""
    html = F.coalesce(html, F.lit(""))
    canonical = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*\d*\s*;?\s*url\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.array_distinct(F.filter(F.array(canonical, refresh), lambda x: x != ""))


def base_href(html: Column) -> Column:
    """The href of a page's first base element that has one, else ''."""
    return F.regexp_extract(html, r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; plain nesting would repeat it at every mention."""
    return F.transform(F.array(value), use)[0]


def without_dots(path: Column) -> Column:
    """A path from the root with its '.' and '..' segments resolved."""
    none = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    open_end = lambda parts: F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    short = lambda parts: F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, none, step), open_end(parts)), "/"))
    return _let(path, lambda p: F.when(p.contains("/."), _let(F.split(F.substring(p, 2, F.length(p)), "/", -1), short)).otherwise(p))


#: Scheme with host, path, and the rest of a whole url.
_WHOLE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$"


def absolute(target: Column, base: Column) -> Column:
    """A target as a whole url, resolved against ``base`` (RFC 3986); null if it has a scheme without '://', or is relative and the base isn't whole."""
    part = lambda url, k: F.regexp_extract(url, _WHOLE, k)

    def join(x: Column) -> Column:
        to, base, root, path = x["to"], x["base"], x["root"], x["path"]
        return (
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(to.rlike(_WHOLE), to))
            .when(root == "", None)
            .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)", 1), to))
            .when(to.startswith("/"), F.concat(root, to))
            .when(to.startswith("?"), F.concat(root, path, to))
            .when(to.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^[^#]*", 0), to))
            .otherwise(F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^.*/", 0), F.lit("")), F.lit("/")), to))
        )

    joined = _let(base, lambda b: _let(F.struct(target.alias("to"), b.alias("base"), part(b, 1).alias("root"), part(b, 2).alias("path")), join))
    return _let(joined, lambda j: F.concat(part(j, 1), without_dots(part(j, 2)), part(j, 3)))


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) urls from canonical links and refresh redirects, an edge for each; relative ones follow the page's base href or url."""
    html = F.col(html_col)
    found = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("source"), html.alias("html"), F.explode(alias_targets(html)).alias("to"))
    based = found.select("source", "to", F.coalesce(absolute(F.nullif(base_href(F.col("html")), F.lit("")), F.col("source")), F.col("source")).alias("base"))
    return based.select("source", absolute(F.col("to"), F.col("base")).alias("target")).where("target is not null and target != source")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, url, host, path, rule, verdict) for every row of ``pages``.

    ``edges`` (source, target): urls that are the same page, as are urls that
    differ only in what ``url_node`` leaves out; targets need not be in
    ``pages`` and rules hold for them too. A url that a rule fits has the
    rule's verdict. Another url is blocked if its component has a blocked url
    and no allowed one, else it has ``default``. Null, empty and schemeless
    urls have empty host and path and fit no rule; null is nobody's alias.
    Repeated urls share their verdict, one row each; urls and pages of any
    length are taken whole. Empty tables: no rows. Components are found when
    the function is called.
    """
    host, path = host_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    base = base.withColumn("m", match_rule(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("own"))
    if edges is None or edges.isEmpty():
        return base.select("id", "url", "host", "path", "rule", F.coalesce("own", F.lit(default)).alias("verdict"))
    member, _ = components(edges.select(url_node(F.col("source")).alias("u"), url_node(F.col("target")).alias("v")))
    host, path = host_path(F.col("node"))
    decided = member.withColumn("own", match_rule(host, path, rules)["verdict"])
    verdicts = decided.groupBy("root").agg(F.bool_or(F.col("own") == "block").alias("blocked"), F.bool_or(F.col("own") == "allow").alias("allowed"))
    passed = decided.join(verdicts.where("blocked and not coalesce(allowed, false)").select("root"), "root", "left_semi").select("node", F.lit("block").alias("passed"))
    return base.withColumn("node", url_node(F.col("url"))).join(passed, "node", "left").select("id", "url", "host", "path", "rule", F.coalesce("own", "passed", F.lit(default)).alias("verdict"))
