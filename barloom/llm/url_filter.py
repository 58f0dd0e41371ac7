"""URL filters with redirect equivalence (operator 9).

A rule names a host and a path prefix and fits that host and its subdomains.
Pages that no rule fits take the decision of their aliases: the connected
component over redirects and canonical links, found in the pages' HTML or given
as a table. In a component an explicit allow goes before a block; without
either the page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = "(?is)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
_GOTO = "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node(url: Column) -> Column:
    """A URL without its fragment: what aliases are named by."""
    return F.regexp_replace(url, "(?s)#.*$", "")


def links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst) of canonical links and refresh redirects, relative targets resolved."""
    html = F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit("(?is)<link\\b[^>]*>"), 0)
    tags = F.filter(tags, lambda t: t.rlike("(?is)\\brel\\s*=\\s*[\"']?canonical\\b"))
    metas = F.regexp_extract_all(html, F.lit("(?is)<meta\\b[^>]*>"), 0)
    metas = F.filter(metas, lambda t: t.rlike("(?is)\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b"))
    found = F.concat(
        F.transform(tags, lambda t: F.regexp_extract(t, _HREF, 1)), F.transform(metas, lambda t: F.regexp_extract(t, _GOTO, 1))
    )
    base = F.col("base")
    target = F.col("target")
    root = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    full = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(folder, target))
    )
    pairs = pages.where(F.col(url_col).contains("://") & html.rlike("(?i)canonical|refresh"))
    pairs = pairs.select(F.col(url_col).alias("base"), F.explode(found).alias("target")).where("target <> ''")
    return pairs.select(base.alias("src"), full.alias("dst"))


def _ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, action) of distinct urls; the longest fitting rule, null if none fits."""
    urls = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    labels = F.split("host", "\\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("action").alias("rule_action")
    )
    # Hosts meet rules by equality on their endings, once for each distinct host.
    hosts = urls.select("host").distinct().where("host <> ''")
    near = hosts.select("host", F.explode(ends).alias("rule_host")).join(rules, "rule_host")
    near = near.groupBy("host").agg(F.collect_set(F.struct("rule_host", "rule_path", "rule_action")).alias("rules"))
    out = urls.join(near, "host", "left")
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    # The longest wins; of equal rules an allow.
    named = F.transform(
        fits,
        lambda r: F.struct(
            F.length(F.concat(r["rule_host"], r["rule_path"])).alias("n"),
            (r["rule_action"] == "allow").alias("allow"),
            F.concat(r["rule_host"], r["rule_path"]).alias("rule"),
            r["rule_action"].alias("action"),
        ),
    )
    best = F.array_max(named)
    return out.select("url", "host", "path", best["rule"].alias("rule"), best["action"].alias("action"))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, how), one row for each page.

    ``rules`` has host, path and action (allow or block); ``redirects`` src and
    dst. ``how`` is rule, alias or default. A null URL, or one without ``://``,
    has an empty host and path and no aliases, and is allowed. Repeated URLs are
    one node and get one verdict. URLs that are known only as a target count in
    their component by the rule that fits them. No pages: an empty result;
    further columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    edges = None
    if html_col is not None:
        edges = links(pages, url_col, html_col)
    if redirects is not None:
        given = redirects.select("src", "dst").where("src is not null and dst is not null")
        edges = given if edges is None else edges.unionByName(given)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = rows.where("url is not null").select("url").distinct()
    if edges is not None:
        edges = scratch.save(edges.distinct())
        ends = edges.select(F.col("src").alias("url")).unionByName(edges.select(F.col("dst").alias("url")))
        urls = urls.unionByName(ends).distinct()
    ruled = scratch.save(_ruled(urls, rules).withColumn("node", F.xxhash64(node(F.col("url")))))
    verdict = F.coalesce("action", F.lit("allow"))
    how = F.when(F.col("rule").isNotNull(), "rule").otherwise("default")
    if edges is not None and not edges.isEmpty():
        pairs = edges.select(F.xxhash64(node(F.col("src"))).alias("a"), F.xxhash64(node(F.col("dst"))).alias("b"))
        parts = scratch.save(connected_components(pairs, scratch))
        decided = (
            ruled.where("action is not null")
            .join(parts, F.col("node") == F.col("id"))
            .groupBy("component")
            .agg(F.min("action").alias("spread"))  # allow comes before block
        )
        spread = parts.join(decided, "component").select(F.col("id").alias("node"), "spread")
        ruled = scratch.save(ruled.join(spread, "node", "left"))
        verdict = F.coalesce("action", "spread", F.lit("allow"))
        how = F.when(F.col("rule").isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default")
    ruled = ruled.select("url", "host", "path", "rule", verdict.alias("verdict"), how.alias("how"))
    out = rows.join(ruled, "url", "left")
    empty = F.lit("")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("host", empty).alias("host"),
        F.coalesce("path", empty).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("how", F.lit("default")).alias("how"),
    )
