"""URL filters: explicit rules first, then trust and distrust propagated over the links between hosts.

Trust starts at hosts whose pages the rules allow and follows links; distrust starts at hosts whose pages
they block and follows links backwards, as who links to blocked hosts is suspect.  Both are personalised
PageRanks, iterated side by side as one table; every step is one join and one pre-aggregated sum.
Everything is DataFrame work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.session import delete, written

# The rules, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING = 0.85
#: A host is blocked when its distrust exceeds its trust by what it has if half of its pages are blocked.
THRESHOLD = 0.5 * (1 - DAMPING)
TOLERANCE = 1e-6 * THRESHOLD  # how far any host's rank may be from the limit of the iteration
STEPS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))  # that surely place a seed of one; larger seeds take more
BROADCAST_HOSTS = 50_000
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decides).otherwise(verdict)
    return rule, verdict


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    places = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return places.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("decided"))


def host_links(pages: DataFrame) -> DataFrame:
    """``source, target, links`` between different hosts, counted before they are shuffled."""
    found = pages.select(
        host_of(F.col("url")).alias("source"),
        F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("target"),
    ).select("source", F.translate("target", UPPER, LOWER).alias("target"))
    between = found.where("source <> '' AND target <> '' AND source <> target")
    return between.groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def seeds(judged: DataFrame) -> DataFrame:
    """``kind, host, seed``: shares of each host's pages that the rules allow (trust) or block (distrust)."""
    share = lambda verdict: F.count_if(F.col("decided") == verdict) / F.count(F.lit(1))
    hosts = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    long = hosts.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)"))
    return long.where("seed > 0").select("kind", "host", "seed")


def walks(links: DataFrame) -> DataFrame:
    """``kind, host, next, weight``: links forwards for trust, backwards for distrust, shares of a host's links."""
    out = links.groupBy("source").agg(F.sum("links").alias("all_links"))
    back = links.groupBy("target").agg(F.sum("links").alias("all_links"))
    share = (F.col("links") / F.col("all_links")).alias("weight")
    forward = links.join(out, "source").select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("next"), share)
    backward = links.join(back, "target").select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("next"), share)
    return forward.unionAll(backward)


def steps_needed(seed: float) -> int:
    """Steps after which what is left of seeds of this sum is below the tolerance, whatever the links are."""
    return STEPS + math.ceil(math.log(max(seed, 1.0)) / -math.log(DAMPING))


def propagate(start: DataFrame, steps: DataFrame) -> DataFrame:
    """``kind, host, rank``: personalised PageRanks from the seeds; ranks of hosts without links stay there.

    The sum of all changes of a step, times damping / (1 - damping), bounds what later steps can add to
    any host.  The iteration ends when that is below the tolerance, on any graph after ``steps_needed``.
    """
    base = start.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("rank"))
    ranks, outdated = base, None
    most = steps_needed(start.agg(F.sum("seed")).first()[0] or 0.0)
    for _ in range(most):
        moved = steps.join(ranks, ["kind", "host"]).select(
            "kind", F.col("next").alias("host"), (F.col("rank") * F.col("weight") * DAMPING).alias("rank")
        )
        fresh = moved.unionAll(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        fresh = written(fresh, "ranks")  # cut the growing plan; shared by the test and the next step
        gap = fresh.join(ranks.withColumnRenamed("rank", "before"), ["kind", "host"], "left")
        change = gap.agg(F.sum(F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0)))).alias("change")).first()["change"]
        if outdated:
            delete(start.sparkSession, outdated)
        ranks, outdated = fresh, fresh.scratch
        if (change or 0) * DAMPING / (1 - DAMPING) < TOLERANCE:
            break
    return ranks


def blocked_hosts(judged: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Hosts whose distrust exceeds their trust by more than ``threshold``."""
    ranks = propagate(written(seeds(judged), "seeds"), written(walks(links), "walks"))
    signed = F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(-F.col("rank"))
    return ranks.groupBy("host").agg(F.sum(signed).alias("excess")).where(F.col("excess") > threshold).select("host")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    The longest fitting rule decides.  Where none fits, a page is blocked if its host is, else allowed;
    so are pages without a host, and hosts that nothing is known about.  Null urls and urls without
    ``://`` have empty host and path; null pages of html have no links; repeated rows are judged one by
    one and count as often as they occur.  Other columns are not read.
    """
    judged = judged_by_rules(pages, rules)
    blocked = written(blocked_hosts(judged, written(host_links(pages), "links")), "blocked").withColumn("bad", F.lit(True))
    few = blocked.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    met = judged.join(F.broadcast(blocked) if few else blocked, "host", "left")
    verdict = F.coalesce("decided", F.when(F.col("bad"), "block").otherwise("allow"))
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
