"""URL verdicts from host and path rules, carried over redirects.

A rule names a host and a path start and fits the host, its subdomains and
every path that begins with its path; the longest rule that fits decides. URLs
that redirect to each other or name each other as canonical are aliases: the
connected components of those edges. A URL without a rule of its own takes its
component's verdict, where an explicit allow of any alias goes before blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affordspark.llm.components import connected_components
from affordspark.llm.storage import tagged, written

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # begins with "/"

    @property
    def name(self) -> str:
        return self.host + self.path


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ? or #, A-Z in lower case; null: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def with_rules(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """df plus host, path, rule and verdict by the rules alone (null: none).

    The longest host wins, then the longest path; rules are a short list, given
    as constants, so every row is judged where it is read."""
    ordered = sorted(rules, key=lambda r: (len(r.host), len(r.path)), reverse=True)
    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fit = _fits(r, F.col("host"), F.col("path"))
        rule = F.when(fit, r.name).otherwise(rule)
        verdict = F.when(fit, r.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "verdict": verdict})


def node_of(url: Column) -> Column:
    """The URL as a node of the alias graph: without its fragment, scheme and
    host in lower case. Null without ://."""
    whole = r"(?s)^(.*?://[^/?#]*)([^#]*)"
    tail = F.regexp_extract(url, whole, 2)
    return F.when(F.contains(url, F.lit("://")),
                  F.concat(F.translate(F.regexp_extract(url, whole, 1), _UP, _LOW), F.when(tail == "", "/").otherwise(tail)))


def _absolute(href: Column, base: Column) -> Column:
    """href resolved against the URL of its page."""
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (F.when(F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), href)
            .when(F.startswith(href, F.lit("//")), F.concat(F.substring_index(base, "://", 1), F.lit(":"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
            .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_extract(base, "^[^?#]*", 0), href))
            .when((href != "") & ~F.startswith(href, F.lit("#")) & ~F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")),
                  F.concat(origin, F.when(folder == "", "/").otherwise(folder), href)))


_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?\s*\d+\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes of every canonical link and refresh redirect that the
    pages declare. Pages without one, or with a null url or html, give none."""
    tags = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (_CANONICAL, _REFRESH)])
    return (pages.where(F.rlike(html, F.lit(r"(?i)canonical|http-equiv")))
            .select(F.col(url).alias("base"), F.explode(tags).alias("href")).where("href != ''")
            .select(node_of(F.col("base")).alias("src"), node_of(_absolute(F.regexp_replace("href", "&amp;", "&"), F.col("base"))).alias("dst"))
            .where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct())


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame, keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """keep columns plus host, path, rule, verdict and source (rule, alias or
    default) for every page.

    ``edges`` (src, dst) are redirects and canonical links between nodes
    (``node_of``); a node that is only an edge's end counts with its own rule.
    A page whose url a rule fits has that rule's verdict; else, if an alias is
    explicitly allowed, allow; else, if an alias is blocked, block; else the
    default. Null urls are alone. Repeated rows are judged each; an empty edge
    table leaves the rules; kept columns named like a result get the suffix
    _in."""
    made = {"host", "path", "rule", "verdict", "source"}
    mine = tagged(*[f"k{i}" for i in range(len(keep))])
    u, node = tagged("url", "node")
    named = pages.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, mine)], F.col(url).alias(u))
    judged = with_rules(named, rules, u)
    comps = connected_components(edges, "src", "dst")
    of = written(with_rules(comps, rules, "node").select("node", "component", F.col("verdict").alias("own")), "aliases")
    by = of.groupBy("component").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    verdicts = of.join(by, "component").select(F.col("node").alias(node), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict"))
    # only pages without a rule look at the aliases; null nodes meet none
    out = judged.withColumn(node, F.when(F.col("verdict").isNull(), node_of(F.col(u)))).join(verdicts.where("alias_verdict IS NOT NULL"), node, "left")
    return out.select(*[F.col(x).alias(f"{c}_in" if c in made else c) for c, x in zip(keep, mine)], "host", "path", "rule",
                      F.coalesce("verdict", "alias_verdict", F.lit(default)).alias("verdict"),
                      F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default").alias("source"))
