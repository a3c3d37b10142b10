"""URL filters with redirect equivalence, in DataFrame operations only.

Urls that differ by what servers redirect anyway (scheme, ``www.``, default port, fragment, ``utm_`` parameters, closing
slash) are one node. Canonical links and meta refreshes of the pages are edges between nodes. A connected component is
one set of aliases: without a rule of its own, a url is allowed if any alias is allowed by a rule, else blocked if any is
blocked, else allowed.

Null and relative urls have an empty host and path, fit no rule and have no alias: they are allowed. Equal urls on
several pages get equal rows; an empty table gives an empty result. Of rules that fit with equal length, allow wins,
then the lexically least. Texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.graph import components
from groundline.llm.tables import cut, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules of op1: fixed by its contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def alias_key(url: Column) -> Column:
    """The node of a url: what remains of it after what redirects change; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.concat_ws("&", F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _targets(html: Column, mark: str, tag: str, attribute: str) -> Column:
    tags = F.when(F.contains(F.lower(html), F.lit(mark)), F.regexp_extract_all(html, F.lit(tag), F.lit(0)))
    return F.transform(tags, lambda t: F.replace(F.regexp_extract(t, attribute, 1), F.lit("&amp;"), F.lit("&")))


def resolved(url: Column, target: Column) -> Column:
    """A link's target as a full url."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(url, URL, 1))
    return (
        F.when(target == "", None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .otherwise(F.concat(root, F.regexp_replace(F.regexp_extract(url, URL, 2), r"[^/]*$", ""), F.when(F.regexp_extract(url, URL, 2) == "", F.lit("/")).otherwise(""), target))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): alias nodes that a canonical link or a meta refresh makes equivalent."""
    targets = F.concat(F.coalesce(_targets(F.col(html), "canonical", LINK, HREF), F.array()), F.coalesce(_targets(F.col(html), "refresh", META, REFRESH), F.array()))
    found = pages.select(F.col(url).alias("url"), F.explode(targets).alias("to"))
    return found.select(alias_key(F.col("url")).alias("a"), resolved(F.col("url"), F.col("to")).alias("to")).select("a", alias_key(F.col("to")).alias("b"), "to")


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of each distinct host and path that a rule fits.

    Every host is joined once by each of its suffixes at a dot, so the work grows with the distinct hosts and their
    rules; the path is a residual test. ``rules`` has the columns rule and action.
    """
    r = rules.select("rule", "action", F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)(.*)$", 1), UPPER, LOWER).alias("suffix"), F.regexp_extract("rule", r"(?s)^([^/]*)(.*)$", 2).alias("start"))
    u = urls.filter("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    u = u.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    fits = u.join(r, (u.suffix == r.suffix) & u.path.startswith(r.start)).select(u.host, u.path, "rule", "action")
    order = F.struct(-F.length("rule"), F.col("action"), F.col("rule"))  # allow sorts before block
    return fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), order).alias("r")).select("host", "path", "r.rule", "r.action")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(key, host, path, rule, verdict, alias_root) for every row of pages.

    ``html`` None: without links, only the redirect forms join urls. alias_root is the component's least node.
    """
    p = pages.select(F.col(key).alias(key), F.col(url).alias("url"), *([F.col(html).alias("html")] if html else []))
    judged = p.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), alias_key(F.col("url")).alias("node"))
    if html:
        links = cut(link_edges(p).filter("b is not null"))
        roots = components(links)
        extra = links.select(host_of(F.col("to")).alias("host"), path_of(F.col("to")).alias("path"), F.col("b").alias("node"))
        members = judged.select("host", "path", "node").union(extra)
    else:
        roots, members = None, judged.select("host", "path", "node")
    members = members.filter("node is not null").distinct()
    best = best_rules(members, rules)
    if roots is not None:
        roots = roots.withColumnRenamed("component", "root")
        members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        members = members.withColumn("root", F.col("node"))
    # one row an alias set; where no rule spoke there is none
    said = members.join(best, ["host", "path"]).groupBy("root").agg(F.min("action").alias("said"))
    told = members.select("node", "root").distinct().join(said, "root")
    out = judged.join(best, ["host", "path"], "left").join(told, "node", "left")
    verdict = F.coalesce("action", "said", F.lit("allow"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("root", "node").alias("alias_root"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, action string")
    return judge(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


_KEY = """CASE WHEN {host} <> '' THEN regexp_replace(regexp_replace({host}, ':(80|443)$', ''), '^www\\.', '') || regexp_replace({path}, '/+$', '')
  || coalesce('?' || nullif(list_aggregate(list_filter(string_split(regexp_extract({url}, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), 'string_agg', '&'), ''), '') END"""


def _parsed(url: str) -> tuple[str, str]:
    host = f"translate(coalesce(regexp_extract({url}, '{URL}', 1), ''), '{UPPER}', '{LOWER}')"
    return host, f"coalesce(regexp_extract({url}, '{URL}', 2), '')"


_Q = "[\"'']"
ORACLE = f"""
WITH RECURSIVE rules(rule, action) AS (VALUES {", ".join(f"('{r}', '{a}')" for r, a in RULES)}),
p AS (SELECT page_id, url, {_parsed("url")[0]} AS host, {_parsed("url")[1]} AS path, html FROM pages),
pk AS (SELECT page_id, url, host, path, {_KEY.format(host="host", path="path", url="url")} AS node,
  list_concat(
    list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}'), lambda t: regexp_extract(t, '{HREF.replace("'", "''")}', 1)),
    list_transform(regexp_extract_all(html, '{META.replace("'", "''")}'), lambda t: regexp_extract(t, '{REFRESH.replace("'", "''")}', 1))) AS links FROM p),
l AS (SELECT url, node AS a, replace(unnest(links), '&amp;', '&') AS t FROM pk),
lt AS (SELECT a, CASE WHEN t = '' THEN NULL
  WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t
  WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || regexp_extract(url, '{URL}', 1) || t
  WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t
  ELSE regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || regexp_extract(url, '{URL}', 1) || regexp_replace(regexp_extract(url, '{URL}', 2), '[^/]*$', '')
    || CASE WHEN regexp_extract(url, '{URL}', 2) = '' THEN '/' ELSE '' END || t END AS url FROM l),
lk AS (SELECT a, url, {_parsed("url")[0]} AS host, {_parsed("url")[1]} AS path FROM lt),
e AS (SELECT a, {_KEY.format(host="host", path="path", url="url")} AS b, host, path FROM lk),
both_ways AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
m AS (SELECT host, path, node FROM pk WHERE node IS NOT NULL UNION SELECT host, path, b FROM e WHERE b IS NOT NULL),
reach(node, other) AS (SELECT DISTINCT node, node FROM m UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
fits AS (SELECT host, path, rule, action FROM (SELECT DISTINCT host, path FROM m) u JOIN rules
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))),
best AS (SELECT host, path, rule, action FROM fits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, action, rule) = 1),
said AS (SELECT r.node, min(action) AS said FROM reach r JOIN m ON m.node = r.other JOIN best USING (host, path) GROUP BY r.node)
SELECT page_id, pk.host, pk.path, rule, coalesce(action, said, 'allow') AS verdict
FROM pk LEFT JOIN best ON pk.host = best.host AND pk.path = best.path LEFT JOIN said ON pk.node = said.node
"""
