"""URL filter: rules on host and path, and trust propagated over host links.

Personalised PageRank runs forward from trusted hosts and, on the reversed
edges, from blocked hosts; a host whose share of distrust reaches a threshold
is blocked. Everything is DataFrame work: links become one weighted edge per
pair of hosts before any iteration.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tenderlake.llm.common import cut

#: (rule, verdict); a rule is a host, then a path that starts with "/"
Rules = Sequence[tuple[str, str]]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), or null.

    A rule fits its host and all subdomains. ``rules`` is an argument list
    and becomes part of the plan, so it costs no shuffle."""
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"),
                                         F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(none, *fits))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted per pair.

    Only links that name a host count (``//host`` or ``scheme://host``);
    relative links stay on their host and carry no trust across."""
    link = r"""[hH][rR][eE][fF]\s*=\s*["']?\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
    return (pages.select(host_of(F.col("url")).alias("src"),
                         F.explode(F.regexp_extract_all("html", F.lit(link), F.lit(1))).alias("dst"))
            .select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
            .where("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("weight")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85,
              tolerance: float = 1e-4, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) of two personalised PageRanks in one iteration.

    ``seeds``: (host, trust, distrust) masses; ``edges``: (src, dst, weight).
    Trust follows links, distrust runs against them. A host without onward
    edges passes nothing on: returning its mass to the seeds would scale all
    scores of that kind alike. Stops when the total change is under
    ``tolerance`` of the seed mass: a change shrinks by ``damping`` a round, so
    that is so after log(tolerance) / log(damping) rounds at the latest, and a
    host further away than that gets less than ``tolerance``. With a smaller
    ``rounds``, ranks that still change raise. Each round's ranks are written
    to the shared folder, and so are the sums that edges are joined to: (kind,
    host) keys join as plain shuffles, so AQE splits a hub's edges.
    """
    rounds = rounds or math.ceil(math.log(tolerance) / math.log(damping)) + 1
    out = cut(edges.groupBy("src").agg(F.sum("weight").alias("t")), "out")
    into = cut(edges.groupBy("dst").agg(F.sum("weight").alias("t")), "into")
    fwd = edges.join(out, "src").select(
        F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"),
        (F.col("weight") / F.col("t")).alias("p"))
    back = edges.join(into, "dst").select(
        F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"),
        (F.col("weight") / F.col("t")).alias("p"))
    steps = cut(fwd.unionByName(back), "steps")
    base = cut(seeds.select("host", F.explode(F.create_map(
        F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "mass"))
        .where("mass > 0").select("kind", "host", (F.col("mass") * (1 - damping)).alias("r")), "seeds")
    total = base.agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
    ranks, change = base, None
    for _ in range(rounds):
        moved = ranks.join(steps, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (F.col("p") * F.col("r") * damping).alias("r"), F.lit(0.0).alias("old"))
        ranks = cut(moved.unionByName(base.withColumn("old", F.lit(0.0)))
                    .unionByName(ranks.select("kind", "host", F.lit(0.0).alias("r"), F.col("r").alias("old")))
                    .groupBy("kind", "host").agg(F.sum("r").alias("r"), F.sum("old").alias("old")), "ranks")
        change = ranks.agg(F.coalesce(F.sum(F.abs(F.col("r") - F.col("old"))), F.lit(0.0))).first()[0]
        ranks = ranks.drop("old")
        if change <= tolerance * total:
            break
    else:
        raise RuntimeError(f"ranks still change by {change / total:.2g} of the seeds after {rounds} rounds")
    mass = lambda k: F.sum(F.when(F.col("kind") == k, F.col("r")).otherwise(0.0)).alias(k)
    return ranks.groupBy("host").agg(mass("trust"), mass("distrust"))


def judge_urls(pages: DataFrame, rules: Rules, block_share: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, distrust_share, evidence.

    Seeds are the rules' own decisions: a host's trust is its share of all
    pages that a rule allows, its distrust its share of those that a rule
    blocks, so neither kind wins by its number of pages. evidence tells what
    a verdict rests on: ``rule``, ``host`` (pages of the host that rules
    judge, and what links bring), ``links`` alone, or ``none``. Where no
    rule fits, the page is blocked if its host's propagated distrust is at
    least ``block_share`` of trust + distrust. A host without any evidence,
    and a null, empty or host-less url, is allowed (share null). Repeated
    rows are judged alike; other columns of ``pages`` are ignored; an empty
    table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    judged = (pages.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"),
                           path_of(F.coalesce("url", F.lit(""))).alias("path"))
              .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)))
    seeds = (judged.where("host <> ''").groupBy("host").agg(
        F.sum(F.when(F.col("fit.verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("fit.verdict") == "block", 1.0).otherwise(0.0)).alias("distrust")))
    seeds = cut(seeds.where("trust > 0 or distrust > 0"), "judged")
    total = seeds.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]).first()
    seeds = seeds.select("host", *[(F.col(k) / F.lit(total[k] or 1.0)).alias(k) for k in ("trust", "distrust")])
    scores = propagate(seeds, cut(host_links(pages), "links"))
    shares = scores.join(seeds.select("host", F.lit("host").alias("own")), "host", "left").select(
        "host", (F.col("distrust") / (F.col("trust") + F.col("distrust"))).alias("distrust_share"), F.coalesce("own", F.lit("links")).alias("evidence"))
    shares = cut(shares, "shares")  # pages of a big host are split by AQE
    blocked = F.coalesce(F.col("distrust_share") >= block_share, F.lit(False))
    return judged.join(shares, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "distrust_share",
        F.when(F.col("fit.rule").isNotNull(), "rule").otherwise(F.coalesce("evidence", F.lit("none"))).alias("evidence"))
