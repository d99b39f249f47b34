"""URL rules, and for hosts that no rule fits, trust and distrust propagated over the link graph of hosts.

A rule is a host suffix and a path prefix; the longest that fits decides. Where none fits, the host's links decide:
personalised PageRank spreads trust from hosts that have allowed pages along links, and distrust goes from hosts that have
blocked pages against them (a page that links to blocked hosts is suspect). Both are counted in shares of a host's own
pages, so they don't depend on the rest of the corpus. A host is blocked if its distrust reaches the threshold and
exceeds its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Verdict and rule (host, path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LINK = "(?i)href\\s*=\\s*[\"']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        suffix, slash, rest = text.partition("/")
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b, n): pages of host a hold n links to another host b."""
    target = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))
    found = pages.select(host_of(F.col(url_col)).alias("a"), target.alias("to"))
    absolute = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return found.select("a", host_of(absolute).alias("b")).where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def page_rank(seeds: DataFrame, links: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(host, rank): personalised PageRank from seeds(host, share) over links(a, b, n).

    What a host without links would pass on is dropped, so ranks sum to the sum of shares at most. Hosts that nothing
    reaches are left out.
    """
    out = links.groupBy("a").agg(F.sum("n").alias("all"))
    return spread(seeds, links.join(out, "a").select("a", "b", (F.col("n") / F.col("all")).alias("w")), rounds, damping)


def spread(seeds: DataFrame, steps: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(host, rank): each round, 1 - damping of the seeds' shares and damping * w of a's rank to b, over steps(a, b, w).

    Each round is one join and one sum.
    """
    steps = written(steps, "steps")
    base = seeds.select("host", ((1 - damping) * F.col("share")).alias("rank"))
    if steps.isEmpty():
        return base
    rank = base
    for _ in range(rounds):
        moved = rank.join(steps, F.col("host") == F.col("a")).select(F.col("b").alias("host"), (damping * F.col("rank") * F.col("w")).alias("rank"))
        rank = written(base.unionByName(moved).groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
    return rank


def judged_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, rounds: int = 8, damping: float = 0.85, least_distrust: float = 0.5
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages.

    A host's seed is the share of allowed, or blocked, ones among all its pages, with or without a rule. trust and distrust
    are those of the host, in units of what a host gets from itself if a rule allows, or blocks, all its pages, and 0 where
    nothing reaches it. A link to another host passes on 1 / max(pages, links to other hosts) of that one's distrust, so
    neither further hosts nor others that link to the same one change it. Without links between hosts, a page without a
    rule is blocked if rules block at least the share least_distrust of its host's pages, and more than they allow. A null url, or one without ://, has an empty host, which no link reaches: it is allowed.
    Null html has no links. Rows that repeat an id are rows of their own. An empty table gives an empty one.
    """
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    named = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = named.withColumn("rule", rule).withColumn("ruling", verdict)
    counts = written(ruled.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruling") == "allow").alias("allowed"), F.count_if(F.col("ruling") == "block").alias("blocked")), "hosts")
    links = written(host_links(pages, url_col, html_col), "host_links")
    seeds = lambda col: counts.where(F.col(col) > 0).select("host", (F.col(col) / F.col("pages")).alias("share"))
    trust = page_rank(seeds("allowed"), links, rounds, damping).select("host", (F.col("rank") / (1 - damping)).alias("trust"))
    own = links.groupBy("a").agg(F.sum("n").alias("all")).join(counts.select(F.col("host").alias("a"), "pages"), "a")
    back = links.join(own, "a").select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") / F.greatest("pages", "all")).alias("w"))
    distrust = spread(seeds("blocked"), back, rounds, damping).select("host", (F.col("rank") / (1 - damping)).alias("distrust"))
    known = trust.join(distrust, "host", "full_outer").where("host <> ''")
    out = ruled.join(known, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    by_links = F.when((F.col("distrust") >= least_distrust) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", by_links).alias("verdict"), "trust", "distrust")


