"""URL filters with redirect equivalence (operator 10).

Native: SQL functions and joins only. A page is judged by the longest rule
that fits its URL. Pages without a rule of their own take part in
redirect equivalence: URLs joined by redirects (``<meta http-equiv=refresh>``),
canonical links (``<link rel=canonical>``) or by naming the same host, path
and query form one component (distributed connected components); rules look
at host and path alone. Inside a
component an explicit allow takes precedence over a block: the component
blocks its members without a rule only if one of its URLs is blocked by a
rule and none is allowed by one. Otherwise they are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distillery.llm.components import connected_components
from distillery.llm.shared import col, cut


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the contract
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
    lower-cased; empty for a null URL or one without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null.
    The longest host decides, then the longest path, then an allow."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host), r.verdict != "allow", r.name))
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def link_targets(html: Column) -> Column:
    """The URLs that a page names as its canonical form or redirects to."""
    html = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    hrefs = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    moves = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i);\s*url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    return F.transform(F.filter(F.concat(hrefs, moves), lambda u: u != ""), _decoded)


def _decoded(attribute: Column) -> Column:
    return F.regexp_replace(attribute, r"(?i)&(amp|#0*38|#x0*26);", "&")


def base_target(html: Column) -> Column:
    """The ``<base href>`` of a page as it is written; empty without one."""
    return _decoded(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<base\b[^>]*?\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))


def url_query(url: Column) -> Column:
    """The query, from its ``?`` on; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)


def resolve(target: Column, site: Column, path: Column) -> Column:
    """The absolute form of a link on a page of ``site`` (scheme and host) and
    ``path``: with a scheme and ``://`` as it is, ``//host/path`` by the
    scheme, ``/path`` by the host, and any other by the directory of the path
    (``?query`` and ``#part`` alone by the path). Schemes without ``://``
    (``mailto:``) are null."""
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"(?s)[^/]*$", "")).otherwise("/")
    named = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?", 0)
    return (F.when(named.endswith("//"), target)
            .when(named != "", F.lit(None).cast("string"))
            .when(target.startswith("//"), F.concat(F.substring_index(site, "//", 1), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(F.substring(target, 1, 1).isin("?", "#"), F.concat(site, path, target))
            .otherwise(F.concat(site, folder, target)))


def _site(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(u, v, host, path)``: the nodes of each page's URL and of a URL that
    it names, and the latter's host and path. Links are cut off the pages
    first, then resolved in two steps: the base of the page, the link."""
    u, h = col(url), col(html)
    raw = cut(pages.filter(u.contains("://")).select(u.alias("url"), base_target(h).alias("b"), F.explode(link_targets(h)).alias("t")))
    based = F.when(F.col("b") == "", F.col("url")).otherwise(
        F.coalesce(resolve(F.col("b"), _site(F.col("url")), url_path(F.col("url"))), F.col("url")))
    raw = cut(raw.select("url", "t", based.alias("base")))
    full = cut(raw.select(_node(F.col("url")).alias("u"),
                          resolve(F.col("t"), _site(F.col("base")), url_path(F.col("base"))).alias("target")).filter("target IS NOT NULL"))
    t = F.col("target")
    return cut(full.select("u", _node(t).alias("v"), url_host(t).alias("host"), without_dots(url_path(t)).alias("path"))
               .filter("u IS NOT NULL AND v IS NOT NULL"))


def without_dots(path: Column) -> Column:
    """The path without its ``.`` and ``..`` segments."""
    dot = lambda s: F.regexp_replace(s, "(?i)%2e", ".")
    parts = F.split(path, "/")

    def step(kept: Column, s: Column) -> Column:
        return (F.when(dot(s) == ".", kept)
                .when(dot(s) == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
                .otherwise(F.concat(kept, F.array(s))))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    # a dot segment at the end leaves its folder
    tail = F.when(dot(F.element_at(parts, -1)).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def _node(url: Column) -> Column:
    """A URL's node: host, path without dot segments (an empty path is ``/``)
    and query, by hash; null without a host."""
    host, path = url_host(url), url_path(url)
    return F.when(host != "", F.xxhash64(host, F.when(path == "", F.lit("/")).otherwise(without_dots(path)), url_query(url)))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", page_id: str = "page_id",
               html: str | None = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path, no rule
    and no aliases, and is allowed. Null pages have no links. Repeated rows
    are judged alike; an empty table gives no rows; other columns are not
    read. Linked URLs need not be pages: they carry their rule's verdict
    into the component all the same.
    """
    u = col(url)
    rows = pages.select(col(page_id).alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path"), _node(u).alias("node"))
    rows = rows.withColumn("own", match_rule(F.col("host"), F.col("path"), rules))
    links = link_edges(pages, url, html) if html is not None and html in pages.columns else None
    answer = F.coalesce(F.col("own.verdict"), F.col("spread"), F.lit("allow"))
    if links is None or links.isEmpty():
        # without links an alias is a page of the same URL, and such pages have
        # the same rule
        rows = rows.withColumn("spread", F.lit(None).cast("string"))
        return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), answer.alias("verdict"))
    comp = connected_components(links.select("u", "v"))
    judged = (rows.select("node", F.col("own.verdict").alias("verdict")).filter("node IS NOT NULL")
              .unionByName(links.select(F.col("v").alias("node"),
                                        match_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict")))
              .filter("verdict IS NOT NULL").distinct())
    spread = (judged.join(comp, "node").groupBy("component")
              .agg(F.max(F.col("verdict") == "allow").alias("allowed"))
              .select("component", F.when(F.col("allowed"), F.lit("allow")).otherwise(F.lit("block")).alias("spread")))
    aliases = cut(comp.join(spread, "component").select("node", "spread"))
    # only pages without a rule need their component
    open_rows = rows.filter("own IS NULL").join(aliases, "node", "left")
    ruled = rows.filter("own IS NOT NULL").withColumn("spread", F.lit(None).cast("string"))
    both = open_rows.unionByName(ruled)
    return both.select("page_id", "host", "path", F.col("own.rule").alias("rule"), answer.alias("verdict"))
