"""URL rules with redirect equivalence: block decisions reach every alias, explicit allow rules come first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from litquarry.llm.components import connected_components
from litquarry.scale import cut, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"  # host, path, query
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
Rule = tuple[str, str, str]  # action (block or allow), host, path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def address(url: Column) -> Column:
    """What names a page whatever its scheme and fragment: host, path, query. Null where the url has no ``://``."""
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_extract(url, URL, 3)))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, action) of the longest rule that fits the host or a domain above it and begins the path; else null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """(u, v) addresses joined by a canonical link or a refresh redirect in a page's html; relative targets are resolved.

    Null urls or html and targets that cannot be resolved give no edge.
    """
    def targets(tag: str, attribute: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, attribute, 1))

    own = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://")).select(
        "url", F.explode(F.array_distinct(F.concat(targets(CANONICAL, HREF), targets(REFRESH, REFRESH_URL)))).alias("_to")).where(F.col("_to") != "")
    to, root = F.replace("_to", F.lit("&amp;"), F.lit("&")), F.concat(F.lit("x://"), host_of(F.col("url")))
    full = (F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(to.startswith("/"), F.concat(root, to))
            .otherwise(F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")), to)))
    return own.select(address(F.col("url")).alias("u"), address(full).alias("v")).where(F.col("u") != F.col("v"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    The longest fitting rule decides. A page without one is blocked if any address in its class of redirect and
    canonical equivalence is blocked by a rule, be it a page or only a link's target; an explicit allow rule of its
    own protects a page, and allow decisions do not travel. Everything else is allowed. ``redirects`` holds further
    (from_url, to_url) pairs. A null url, or one without ``://``, has empty host and path and is its own class.
    Repeated rows give repeated results; columns other than page_id, url and html are not read. An address with
    very many aliases is only a join key; its class costs one row per alias and round.
    """
    edges = page_links(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("from_url")).alias("u"), address(F.col("to_url")).alias("v")))
    classes = connected_components(edges)
    node = F.concat(F.lit("x://"), F.col("node"))
    judged = cut(classes.withColumn("_bad", F.coalesce(best_rule(host_of(node), path_of(node), rules)["action"] == "block", F.lit(False))))
    bad = judged.where("_bad").select("component").distinct()
    blocked = judged.join(small_side(bad), "component", "left_semi").select(F.col("node").alias("_address"), F.lit(True).alias("_alias_blocked"))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("_address"))
    own = own.withColumn("_r", best_rule(F.col("host"), F.col("path"), rules)).join(small_side(blocked), "_address", "left")
    return own.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(
        F.col("_r.action"), F.when(F.col("_alias_blocked"), "block"), F.lit("allow")).alias("verdict"))
