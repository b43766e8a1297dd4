"""URL filter whose block decisions spread over redirects and canonical links. Native only.

Rules name a host and a path prefix. A rule fits its host and all subdomains when the url's
path starts with the rule's path; of the rules that fit, the longest (then the longer host)
decides. Urls that no rule fits are judged by their equivalence class:

* urls that web servers redirect to one another share a node: the scheme, a leading ``www.``
  or ``m.``, query, fragment, a final ``/``, ``/index`` and ``.htm(l)`` do not count;
* ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` in a page are edges from its
  node to its target's (an absolute, ``//host`` or ``/path`` target; others are ignored);
* the connected components of those edges are the classes.

A class that holds a url allowed by a rule is allowed, else one that holds a blocked url is
blocked, else the default holds. A url's own rule always precedes its class.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end. A null url or one without ``://`` has neither, fits
no rule, belongs to no class and gets the default. Null html has no links. Every row gives
one row, repeated and null ids too; extra columns are ignored. The rules are a short list
held by the caller (at most MAX_RULES) and become literals of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise
from .components import connected_components

MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # "allow" or "block"


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

_LINK = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_META = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_GOTO = r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def node_of(host: Column, path: Column) -> Column:
    """The name that a url shares with the urls it is redirected to; null without a host."""
    node = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""),
                    F.regexp_replace(path, r"(/index)?(\.html?)?/?$", ""))
    return F.when(host != "", node)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, host_size, rule, verdict) of the deciding rule, null when none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the filter holds at most {MAX_RULES}")
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                   F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(len(r.host)).alias("host_size"),
                            F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast(
        "struct<size:int,host_size:int,rule:string,verdict:string>")


def link_edges(pages: DataFrame) -> DataFrame:
    """u, v: nodes joined by a canonical link or a refresh."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    links = F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1))
    metas = F.transform(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda t: F.regexp_extract(t, _GOTO, 1))
    target = F.col("target")
    full = (F.when(target.startswith("//"), F.concat(F.lit("x:"), target))
            .when(target.startswith("/"), F.concat(F.lit("x://"), F.col("host"), target)).otherwise(target))
    return (pages.where(F.col("html").isNotNull())
            .select(host.alias("host"), path.alias("path"), F.explode(F.concat(links, metas)).alias("target"))
            .where("host <> ''").withColumn("full", full)
            .select(node_of(F.col("host"), F.col("path")).alias("u"),
                    node_of(host_of(F.col("full")), path_of(F.col("full"))).alias("v")).where("v is not null"))


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = materialise(named.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
                         .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                                 F.col("found.verdict").alias("own"),
                                 node_of(F.col("host"), F.col("path")).alias("node")))
    ruled = judged.where("rule is not null")
    free = judged.where("rule is null")

    classes = connected_components(link_edges(pages)).select(F.col("node").alias("c_node"), "component")
    decided = (ruled.groupBy("node").agg(F.max(F.col("own") == "allow").alias("allowed"))
               .join(classes, F.col("node") == F.col("c_node"), "left")
               .groupBy(F.coalesce("component", "node").alias("d_class"))
               .agg(F.max("allowed").alias("allowed"))
               .select("d_class", F.when(F.col("allowed"), F.lit("allow")).otherwise(F.lit("block")).alias("decision")))
    # Free urls without a host have a null node: kept apart, as a join would gather them.
    by_class = (free.where("node is not null").join(classes, F.col("node") == F.col("c_node"), "left")
                .withColumn("class", F.coalesce("component", "node"))
                .join(decided, F.col("class") == F.col("d_class"), "left")
                .select("page_id", "host", "path", "rule", F.coalesce("decision", F.lit(default)).alias("verdict")))
    nowhere = free.where("node is null").select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"))
    return (ruled.select("page_id", "host", "path", "rule", F.col("own").alias("verdict"))
            .unionByName(by_class).unionByName(nowhere))
