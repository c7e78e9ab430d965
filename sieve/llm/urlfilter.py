"""URL filter with redirect equivalence, with DataFrame operations only.

A rule fits its host and all subdomains where the path starts with the rule's; the
longest one decides.  URLs that redirect to each other or name the same canonical
page are aliases: meta refreshes and canonical links of the pages' HTML (and any
links handed in) join URLs, and connected components are found over all of them.
A URL without a rule of its own gets the decision of its aliases: allow if a rule
allows any alias explicitly, else block if a rule blocks one, else the default.
URLs that differ only in scheme, fragment or tracking parameters are one node.

Defined results: a null URL, or one without ``://``, has empty host and path, no
rule, no alias and the default verdict; null HTML has no links; repeated rows are
judged each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import components

# --- fixed values -----------------------------------------------------------
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ---------------------------------------------------------------------------
DEFAULT = "allow"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def _decided(host: Column, path: Column, rules, what) -> Column:
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, what(rule)) if out is None else out.when(fits, what(rule))
    return out if out is not None else F.lit(None).cast("string")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    return _decided(host, path, rules, lambda r: r[1] + r[2])


def verdict_of(host: Column, path: Column, rules=RULES) -> Column:
    return _decided(host, path, rules, lambda r: r[0])


def node_of(url: Column) -> Column:
    """The URL without scheme, fragment and tracking parameters; null without ``://``."""
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    whole = F.concat(host_of(url), path_of(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def html_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the pages' canonical links and meta refreshes, as absolute URLs."""
    found = F.array(F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1))
    rows = (pages.filter(F.instr("url", "://") > 0).select("url", F.explode(found).alias("to")).filter(F.col("to") != ""))
    host = F.concat(F.lit("http://"), host_of(F.col("url")))
    to = F.col("to")
    full = (F.when(F.instr("to", "://") > 0, to).when(to.startswith("//"), F.concat(F.lit("http:"), to))
            .when(to.startswith("/"), F.concat(host, to))
            .otherwise(F.concat(host, F.regexp_replace(F.when(path_of(F.col("url")) == "", "/").otherwise(path_of(F.col("url"))), r"[^/]*$", ""), to)))
    return rows.select("url", full.alias("target"))


def judge(pages: DataFrame, links: DataFrame | None = None, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict); ``links`` (url, target) adds redirects
    known from elsewhere."""
    said = html_links(pages)
    if links is not None:
        said = said.unionByName(links.select("url", "target"))
    ends = cut_lineage(said.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).filter("a is not null and b is not null and a != b"))
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    host, path = F.col("host"), F.col("path")
    own = own.withColumn("rule", rule_of(host, path, rules)).withColumn("own", verdict_of(host, path, rules))
    aliases = components(ends)
    # the node's own text holds its host and path
    at = F.concat(F.lit("x://"), F.col("node"))
    ruled = aliases.withColumn("own", verdict_of(host_of(at), path_of(at), rules))
    groups = ruled.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    spread = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    decided = aliases.join(groups, "component").select("node", spread.alias("spread")).filter("spread is not null")
    out = own.join(decided, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
own AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(rest, ''), '^[^?#]*\?([^#]*)', 1) AS query FROM parts),
found AS (
  SELECT url, host, path, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
  FROM own WHERE instr(url, '://') > 0),
full_links AS (
  SELECT url, CASE WHEN instr(target, '://') > 0 THEN target WHEN target LIKE '//%' THEN 'http:' || target
    WHEN target LIKE '/%' THEN 'http://' || host || target
    ELSE 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || target END AS target
  FROM found WHERE target <> ''),
urls AS (SELECT DISTINCT u, substr(u, instr(u, '://') + 3) AS rest FROM (
  SELECT url AS u FROM pages UNION SELECT target FROM full_links) WHERE instr(u, '://') > 0),
split AS (
  SELECT u, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p,
         array_to_string([x FOR x IN string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&') IF x <> '' AND NOT starts_with(x, 'utm_')], '&') AS q FROM urls),
nodes AS (SELECT u, h, p, h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS node FROM split),
ruled AS (
  SELECT u, h, p, node, CASE
    WHEN (h = 'www.example.com' OR h LIKE '%.www.example.com') AND starts_with(p, '/en/') THEN 'www.example.com/en/'
    WHEN (h = 'example.com' OR h LIKE '%.example.com') AND starts_with(p, '/en/') THEN 'example.com/en/'
    WHEN (h = 'net' OR h LIKE '%.net') AND starts_with(p, '/es/') THEN 'net/es/'
    WHEN (h = 'net' OR h LIKE '%.net') AND starts_with(p, '/fr/') THEN 'net/fr/'
    WHEN (h = 'com' OR h LIKE '%.com') AND starts_with(p, '/') THEN 'com/' END AS rule FROM nodes),
edges AS (
  SELECT a.node AS x, b.node AS y FROM full_links l JOIN nodes a ON a.u = l.url JOIN nodes b ON b.u = l.target WHERE a.node <> b.node),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y),
spread AS (
  SELECT r.x AS node, bool_or(d.rule IN ('com/', 'www.example.com/en/')) AS allowed, bool_or(d.rule NOT IN ('com/', 'www.example.com/en/')) AS blocked
  FROM reach r JOIN (SELECT DISTINCT node, rule FROM ruled) d ON d.node = r.y GROUP BY r.x)
SELECT o.page_id, o.host, o.path, r.rule, CASE
    WHEN r.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
    WHEN s.allowed THEN 'allow' WHEN s.blocked THEN 'block' ELSE 'allow' END AS verdict
FROM own o LEFT JOIN ruled r ON r.u = o.url LEFT JOIN spread s ON s.node = r.node
"""
