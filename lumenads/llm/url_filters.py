"""URL filters with redirect equivalence.

Rules (host, path, action) judge an url by its host and path. Urls that lead to
one another, by redirects or by the canonical link or refresh of their page, are
aliases: connected components over those edges. A block decision reaches every
alias that no rule of its own decides, unless one of the aliases is explicitly
allowed, which then holds for all undecided ones.

A node is an url without scheme and fragment, its host in lower case. All work is
DataFrame functions; only pages with such a link enter the component rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenads.llm.components import components
from lumenads.llm.tables import prepared, stored, table


class Rule(NamedTuple):
    host: str
    path: str
    action: str

    @property
    def shown(self) -> str:
        return self.host + self.path


# Fixed values of the query: rules in order.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What a browser does not read as markup, the tags that name another url, and their attributes.
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']*?)[\"']?\s*$"


def with_place(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host in lower case and path, both empty for a null url and one without
    ``://``, and node: the url without scheme and fragment, null where there is no host."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    split = (
        urls.withColumn("rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), CAPITALS, SMALL))
        .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn("tail", F.regexp_extract("rest", r"^[^/?#]*([^#]*)", 1))
    )
    tail = F.when(F.startswith("tail", F.lit("/")), F.col("tail")).otherwise(F.concat(F.lit("/"), "tail"))
    return split.withColumn("node", F.when(F.col("host") != "", F.concat("host", tail))).drop("rest", "tail")


def decision(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as (rule, action); null if none does. Rules of one length:
    the longer host first, then allow before block, then by text. The rules are a literal of
    the plan, so they are a list of at most some thousands."""
    ranked = sorted(rules, key=lambda r: (-len(r.shown), -len(r.host), r.action, r.shown))
    fields = ("host", "path", "rule", "action")
    all_rules = F.array(
        *(
            F.struct(*(F.lit(v).alias(n) for n, v in zip(fields, (r.host, r.path, r.shown, r.action))))
            for r in ranked
        )
    ).cast("array<struct<host:string,path:string,rule:string,action:string>>")

    def fits(rule: Column) -> Column:
        inside = F.endswith(F.concat(F.lit("."), host), F.concat(F.lit("."), rule["host"])) & (rule["host"] != "")
        return inside & F.startswith(path, rule["path"])

    return F.get(F.filter(all_rules, fits), F.lit(0))


def _attribute(tag: str, name: str) -> Column:
    return F.trim(F.concat(*(F.regexp_extract(tag, rf"(?is)[\s\"']{name}{VALUE}", i) for i in (1, 2, 3))))


def absolute(links: DataFrame) -> DataFrame:
    """(from_url, to_url) with ``target`` as seen from ``from_url``: absolute, without scheme,
    from the root, a query, or beside the last path part. Dots in paths are left as they are;
    other schemes and targets on the page itself give no link."""
    parts = (
        links.withColumn("scheme", F.regexp_extract("from_url", r"(?s)^(.*?)://", 1))
        .withColumn("root", F.regexp_extract("from_url", r"(?s)^(.*?://[^/?#]*)", 1))
        .withColumn("plain", F.regexp_extract("from_url", r"(?s)^(.*?://[^/?#]*[^?#]*)", 1))
    )
    target, plain = F.col("target"), F.col("plain")
    folder = F.when(F.rlike(plain, F.lit(r"(?s)://[^/]*/")), F.regexp_replace(plain, r"[^/]*$", "")).otherwise(
        F.concat(plain, F.lit("/"))
    )
    to_url = (
        F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat("scheme", F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat("root", target))
        .when(F.startswith(target, F.lit("?")), F.concat(plain, target))
        .when((F.length(target) > 0) & ~F.rlike(target, F.lit(r"^#|^[A-Za-z][A-Za-z0-9+.-]*:")), F.concat(folder, target))
    )
    return parts.select("from_url", to_url.alias("to_url"))


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): canonical links and refreshes in the html of pages."""
    html = F.col("html").cast("string")
    named = pages.select(F.col("url").cast("string").alias("from_url"), html.alias("html")).where(
        "from_url is not null and rlike(html, '(?i)canonical|http-equiv')"
    )
    tags = named.select(
        "from_url", F.explode(F.regexp_extract_all(F.regexp_replace("html", UNREAD, " "), F.lit(TAGS), F.lit(0))).alias("tag")
    )
    read = tags.withColumns(
        {n: _attribute("tag", name) for n, name in (("rel", "rel"), ("equiv", "http-equiv"), ("href", "href"), ("content", "content"))}
    )
    canonical = F.rlike("tag", F.lit(r"(?i)^<link\b")) & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    refresh = F.rlike("tag", F.lit(r"(?i)^<meta\b")) & (F.lower("equiv") == "refresh")
    target = F.when(canonical, F.col("href")).when(refresh, F.trim(F.regexp_extract("content", REFRESH, 1)))
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    # Written, or filters would repeat these expressions in what follows.
    return absolute(stored(read.select("from_url", target.alias("target")), "page-targets"))


def alias_decisions(links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(node, alias_verdict) of every url that a link names and whose component a rule decides.

    The decisions of a component are combined inside tasks first: allow if any of
    its urls is allowed by a rule, else block if any is blocked."""
    prepared(links.sparkSession)
    links = stored(links, "page-links")
    ends = with_place(with_place(links, "from_url").withColumnRenamed("node", "a"), "to_url")
    edges = stored(ends.select("a", F.col("node").alias("b")), "url-links")
    member = components(edges.where("a <> b"), "a", "b")
    members = stored(member.unionByName(member.select(F.col("component").alias("node"), "component")).distinct(), "aliases")
    host, path = F.regexp_extract("node", r"^[^/?#]*", 0), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)
    decided = members.select("component", decision(host, path, rules).getField("action").alias("action")).where(
        "action is not null"
    )
    spread = decided.groupBy("component").agg(F.min("action").alias("alias_verdict"))  # allow before block
    return members.join(spread, "component").select("node", "alias_verdict")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and alias_verdict (null where no alias is decided).

    ``redirects`` has from_url and to_url. An url's own rule wins; then an alias's
    allow, then an alias's block; else it is allowed. Rows repeat as they do in
    ``pages``, null ids included; a null url has no host, fits no rule and is
    allowed; null or very long html is read whole and does no harm. Columns of
    ``pages`` other than page_id, url and html are not read. No pages, no rows.
    """
    prepared(pages.sparkSession)
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(*(F.col(c).cast("string").alias(c) for c in ("from_url", "to_url"))))
    aliases = alias_decisions(links, rules)
    urls = with_place(pages.select("page_id", F.col("url").cast("string").alias("url")))
    own = urls.withColumn("own", decision(F.col("host"), F.col("path"), rules))
    # An url without links and one that its own rule decides need no alias.
    return own.join(aliases, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.action", "alias_verdict", F.lit("allow")).alias("verdict"),
        "alias_verdict",
    )


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the fixed rules, aliases by the links in their html."""
    return judged(table(spark, sf_dir, "pages")).drop("alias_verdict")


# The same rules in SQL; aliases by following links in both directions.
OP12_SQL = r"""
WITH RECURSIVE rules(host, path, action) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (
  SELECT page_id, url, html,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM urls),
own AS (
  SELECT page_id, split.host, split.path, html,
    CASE WHEN split.host <> '' THEN split.host || CASE WHEN tail LIKE '/%' THEN tail ELSE '/' || tail END END AS node,
    arg_max({'rule': r.host || r.path, 'action': action}, length(r.host || r.path)) FILTER (r.host IS NOT NULL) AS own
  FROM split LEFT JOIN rules r
    ON (split.host = r.host OR ends_with(split.host, '.' || r.host)) AND starts_with(split.path, r.path)
  GROUP BY page_id, split.host, split.path, html, tail),
tags AS (
  SELECT node, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS tag FROM own WHERE html ILIKE '%canonical%'),
found AS (
  SELECT node, regexp_extract(tag, 'href="[^:"]*://([^"#]*)"', 1) AS target FROM tags
  WHERE regexp_matches(tag, '(?i)rel="canonical"') AND node IS NOT NULL),
links AS (SELECT node AS a, target AS b FROM found WHERE target <> '' UNION SELECT target, node FROM found WHERE target <> ''),
reached(node, other) AS (
  SELECT a, b FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
spread AS (
  SELECT reached.node, min(own.own.action) AS action FROM reached JOIN own ON own.node = reached.other
  WHERE own.own IS NOT NULL GROUP BY reached.node)
SELECT page_id, host, path, own.own.rule AS rule, coalesce(own.own.action, spread.action, 'allow') AS verdict
FROM own LEFT JOIN spread USING (node)
"""
