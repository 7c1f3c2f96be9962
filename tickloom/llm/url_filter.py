"""Operator 7, URL filters [native]: rules, and link-graph propagation for what no rule decides.

Hosts are nodes; an edge goes from a page's host to every host that the page links, weighted by the number of links,
and both ways between a host and the host that it mirrors (``www.``, ``m.``, ``blog.`` ...). Trust is the personalised
PageRank from the hosts whose pages an allow rule admits; distrust is the same over reversed edges from the hosts
whose pages a block rule refuses, so that linking to a blocked host counts against the one who links. A seed's weight
is the share of its pages. Rounds end when no score changes by more than ``TOLERANCE`` of itself. A host is blocked if
its distrust exceeds ``RATIO`` times its trust, both unrounded; hosts without either are allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Null or
empty html has no links. Repeated pages each get their row and count as pages of their host. An empty table gives an
empty result. Of several rules that fit, the longest (host and path together) wins, ties to the first in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, staged, unstage

#: (verdict, host, path prefix) of the query's rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Rounds between two tests of convergence.
ROUNDS = 12
#: Largest relative change of a score in the last round.
TOLERANCE = 1e-8
RATIO = 1.0
#: Relative excess that a comparison of scores needs, above what is left to the limit.
EXCESS = 1e-6
#: Fixed list of first labels under which a host mirrors another.
MIRRORS = "^(?:www|m|mobile|blog|amp|news|shop|en|de|fr|es)\\."
HREF = "(?i)\\bhref\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


def host_of(url: Column) -> Column:
    """Host after the first ``://``, with A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Path up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict; the rules are tried from the longest on."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, and mirror edges both ways, as shares of the source's weight."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)), ascii_lower))
    links = pages.filter(F.col("html").contains("//") & (F.col("host") != "")).select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    links = links.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.filter(F.col("host") != "").select(F.col("host").alias("src")).distinct()
    mirrors = hosts.filter(F.col("src").rlike(MIRRORS + ".*\\.")).withColumn("dst", F.regexp_replace("src", MIRRORS, ""))
    both = mirrors.select("src", "dst", F.lit(1.0).alias("w")).union(mirrors.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w")))
    return links.union(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) at the limit, tested after every so many rounds; seeds: (host, trust_seed, distrust_seed).

    Both scores move in one pass: trust along shares of the source's weight, distrust back along shares of the target's.
    """
    out_w = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    in_w = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    shares = staged(edges.join(out_w, "src").join(in_w, "dst").select(
        "src", "dst", (F.col("w") / F.col("out_w")).alias("along"), (F.col("w") / F.col("in_w")).alias("back")), "edges")
    seeds = staged(seeds, "seeds")
    score = staged(seeds.select("host", ((1 - damping) * F.col("trust_seed")).alias("trust"), ((1 - damping) * F.col("distrust_seed")).alias("distrust")), "scores")
    start = seeds.select("host", ((1 - damping) * F.col("trust_seed")).alias("t"), ((1 - damping) * F.col("distrust_seed")).alias("d"))
    if not shares.take(1):
        return score
    change = lambda new, old: F.max(F.when(F.col(new) > 1e-290, F.abs(F.col(new) - F.col(old)) / F.col(new)))
    while True:
        for at in range(rounds):
            ahead = shares.join(score, shares.src == score.host).select(F.col("dst").alias("host"), (damping * F.col("along") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
            behind = shares.join(score, shares.dst == score.host).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (damping * F.col("back") * F.col("distrust")).alias("d"))
            after = ahead.union(behind).union(start).groupBy("host").agg(F.sum("t").alias("trust"), F.sum("d").alias("distrust"))
            after = staged(after, "scores")
            if at == rounds - 1:
                old = score.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
                moved = after.join(old, "host", "left").na.fill(0.0, ["t0", "d0"]).agg(F.greatest(change("trust", "t0"), change("distrust", "d0"))).first()[0]
            unstage(score)
            score = after
        if (moved or 0.0) <= tolerance:
            return score


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    named = by_rule(named, rules)
    seeds = named.filter(F.col("host") != "").groupBy("host").agg(
        (F.count_if(F.col("rule_verdict") == "allow") / F.count("*")).alias("trust_seed"),
        (F.count_if(F.col("rule_verdict") == "block") / F.count("*")).alias("distrust_seed"),
    )
    score = propagate(host_edges(named), seeds, damping, rounds)
    blocked = F.col("distrust") > ratio * (1 + EXCESS) * F.col("trust")
    verdicts = score.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), blocked.alias("blocked"))
    judged = named.drop("html").join(small(verdicts), "host", "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
