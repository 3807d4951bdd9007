"""URL filter: path rules, then trust and distrust spread over the graph of hosts.

Rules name a host (and all its subdomains) and the start of a path; the longest
that fits decides. Hosts of allowed pages are the trusted seeds and hosts of
blocked pages the blocked ones. Personalised PageRank spreads trust along links
and distrust against them, since who links to bad hosts is suspect. A page that no
rule fits is blocked if distrust is more than ``threshold`` of what its host got.

All steps are DataFrame operations. Ranks are tables with a row for each host.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Share of a host's rank that moves on along links; the rest returns to the seeds.
DAMPING = 0.85
# Ranks are done when no host's moves by more than this part of itself.
TOLERANCE = 1e-6
THRESHOLD = 0.5


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
DEFAULT_RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """``name, verdict`` of the longest rule that fits, or null; of two equally long ones the first by name."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links between different hosts, counted over all pages.

    Targets are the absolute and scheme-relative addresses in ``href`` attributes; relative ones stay on their host.
    """
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^\"'\s>/?#]+)"), F.lit(1)))
    found = pages.select(host_of(F.col("url")).alias("src"), target.alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return found.filter("src <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host, rank`` of personalised PageRank from ``seeds`` (``host, seed``, summing to 1) over ``edges`` (``src, dst, weight``).

    Ranks are summed per target before they are shuffled, and every round is written, so plans stay short. Rank that
    reaches a host without links goes no further. It ends when a round moves no host's rank by more than ``TOLERANCE`` of
    it, so every host that links reach has its rank, however far; damping bounds the rounds after the last is reached.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_all"))
    shares = stage(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share")), "shares")
    start = stage(seeds.select("host", (F.col("seed") * (1 - damping)).alias("base")), "seeds")
    ranks = start.select("host", F.col("base").alias("rank"))
    while True:
        sent = ranks.join(shares, ranks["host"] == shares["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("got"))
        parts = sent.select("host", "got", F.lit(0.0).alias("was")).union(start.select("host", F.col("base"), F.lit(0.0))).union(ranks.select("host", F.lit(0.0), F.col("rank")))
        new = stage(parts.groupBy("host").agg(F.sum("got").alias("rank"), F.sum("was").alias("was")), "ranks")
        still = new.filter(F.abs(F.col("rank") - F.col("was")) > TOLERANCE * F.col("rank")).isEmpty()
        ranks = new.select("host", "rank")
        if still:
            return ranks


def host_scores(judged: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` for every host that either reached; ``judged`` has ``host, rule`` (with a verdict) of pages."""
    seeds = stage(
        judged.filter("rule is not null")
        .groupBy("host")
        .agg(F.count_if(F.col("rule.verdict") == "allow").alias("good"), F.count_if(F.col("rule.verdict") == "block").alias("bad")),
        "rule_hosts",
    )
    good, bad = seeds.agg(F.sum("good"), F.sum("bad")).first()
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = spread(seeds.filter("good > 0").select("host", (F.col("good") / F.lit(float(good or 1))).alias("seed")), edges, damping)
    distrust = spread(seeds.filter("bad > 0").select("host", (F.col("bad") / F.lit(float(bad or 1))).alias("seed")), backward, damping)
    both = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), F.col("rank")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[UrlRule] = DEFAULT_RULES, threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed, as is a host that
    neither trust nor distrust reached. Null html has no links. Without seeds of a kind there is none of it.
    """
    url = F.col("url")
    judged = stage(
        pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)),
        "judged",
    )
    edges = stage(links(pages), "links")
    scores = stage(host_scores(judged, edges, damping), "host_scores")
    blocked = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("rule.name").alias("rule"),
        F.coalesce(F.col("rule.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
