"""URL filters: list rules first, then trust and distrust that spread over the link graph of hosts.

Trust is a personalised PageRank along links, started at hosts whose pages the rules allow. Distrust runs along the
reversed links, started at hosts whose pages the rules block: who links to a blocked host is suspect. Both ranks divide by
the links a host gives out, so a host's distrust is the chance that a walk from it along its links stops at a blocked page,
at most one seed, and does not shrink however many other hosts link to the same place. Ranks are whole numbers
(billionths of a host's seed), so that sums do not depend on their order and reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, UPPER, saved

#: (verdict, host, path) of the production list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: One host's whole seed, the percentage of rank that follows links, the rounds, and the distrust from which a host
#: whose trust is smaller is blocked.
UNIT, FOLLOW, ROUNDS, THRESHOLD = 1_000_000_000, 85, 10, 50_000_000
#: A written copy ends the lineage after so many rounds.
CUT_EVERY = 5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def link_hosts(html: Column) -> Column:
    """Hosts of all absolute link addresses in a page; links within a site have none."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda h: F.translate(h, UPPER, LOWER))


def host_ranks(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds.

    ``edges``: distinct (src, dst) of different hosts; ``seeds``: (host, trust_seed, distrust_seed), one row per host. A
    host in no seed has no seed; one in no edge keeps (100 - FOLLOW) % of its seed.
    """
    given = edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src")
    hops = saved(given.select("degree", F.inline(F.array(
        F.struct(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(True).alias("forward")),
        F.struct(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(False).alias("forward"))))), "hops")
    keep = 100 - FOLLOW
    start = saved(seeds.select("host", F.explode(F.array(
        F.struct(F.lit(True).alias("forward"), F.expr(f"trust_seed * {keep} div 100").alias("mass")),
        F.struct(F.lit(False).alias("forward"), F.expr(f"distrust_seed * {keep} div 100").alias("mass")))).alias("s"))
        .select("host", "s.forward", "s.mass").where("mass > 0"), "seeds")
    rank = start
    for n in range(rounds if hops.limit(1).count() else 0):
        sent = (rank.withColumnRenamed("host", "at").join(hops, ["at", "forward"])
                .select(F.col("to").alias("host"), "forward", F.expr(f"mass * {FOLLOW} div (100 * degree)").alias("mass")))
        rank = start.unionAll(sent).groupBy("host", "forward").agg(F.sum("mass").alias("mass"))
        if n % CUT_EVERY == CUT_EVERY - 1:
            rank = saved(rank, "rank")
    score = lambda forward: F.coalesce(F.sum(F.when(F.col("forward") == forward, F.col("mass"))), F.lit(0))
    return rank.groupBy("host").agg(score(True).alias("trust"), score(False).alias("distrust"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                rules=RULES) -> DataFrame:
    """Judge every page: (id, host, path, rule, verdict, trust, distrust), one row per input row.

    A rule decides where one fits. Elsewhere the host is blocked if its distrust is at least ``THRESHOLD`` and more
    than its trust. A host's seed is the part of its pages that rules block or allow, so a few blocked paths do not
    condemn a site. Null urls and urls without ``://`` have an empty host and path, no rule and no links, and are
    allowed. Null pages have no links. Repeated rows are judged alike, each in a row of its own; an empty table gives
    an empty table; other columns are ignored.
    """
    url = F.col(url_col)
    facts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn(
        "fit", fitting_rule(F.col("host"), F.col("path"), rules))
    part = lambda v: F.expr(f"count_if(fit.verdict = '{v}') * {UNIT} div count(*)")
    seeds = (facts.where("host <> ''").groupBy("host")
             .agg(part("allow").alias("trust_seed"), part("block").alias("distrust_seed")))
    edges = (pages.select(host_of(url).alias("src"), F.explode(F.array_distinct(link_hosts(F.col(html_col)))).alias("dst"))
             .where("src <> '' and src <> dst").distinct())
    ranks = host_ranks(edges, seeds)
    judged = facts.join(ranks, "host", "left")
    blocked = (F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))
    return judged.select("id", "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce(F.col("fit.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
                         F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
