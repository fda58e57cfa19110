"""URL filters: rules first, then trust and distrust spread over the link graph of hosts.

Trust starts at hosts with pages that a rule allows and follows links; distrust
starts at hosts with pages that a rule blocks and follows links backwards. Both
are personalised PageRank, summed as a series of pushes over host edges (joins and
sums only): until what is left to push is at most `TOLERANCE`, or, with `rounds`, its
first terms only, as in the SQL. A host without a fitting rule is blocked if its distrust
is above its trust and above `floor` shares of an even spread.

Defined cases: a null url, or one without "://", has empty host and path and is
allowed; null html has no links; repeated pages count as often as they occur;
with no links, or no seeds, only the rules block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.llm.common import fresh, materialise

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Pushes of the shortened series that the SQL sums; the query goes on until TOLERANCE.
ROUNDS = 6
#: Of a total mass of 1; as small as the last digit of scores that is compared.
TOLERANCE = 1e-12
#: So many pushes are done between two written tables.
PUSHES = 6
FLOOR = 1.0
#: Up to so many blocked hosts (about 50 MB) are sent to every executor; more are joined by a shuffle.
SENT_HOSTS = 500_000
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: the share of src's links to other hosts that lead to dst."""
    links = pages.select(
        host_of(F.col(url)).alias("src"),
        F.explode(F.expr(f"transform(regexp_extract_all(coalesce({html}, ''), {LINK!r}, 1), x -> translate(x, '{LOWER[0]}', '{LOWER[1]}'))")).alias("dst"),
    ).where("src <> '' and src <> dst")
    counted = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counted.join(counted.groupBy("src").agg(F.sum("n").alias("total")), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def pushed(push: DataFrame, edges: DataFrame, times: int, damping: float) -> list[DataFrame]:
    """host, mass after each of so many pushes."""
    out = []
    for _ in range(times):
        push = push.join(edges, push["host"] == edges["src"]).groupBy("dst").agg((F.sum(F.col("mass") * F.col("weight")) * damping).alias("mass")).withColumnRenamed("dst", "host")
        out.append(push)
    return out


def spread(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, score: the personalised PageRank of `seeds` (host, mass), up to `tolerance` in all hosts together; with `rounds`, what so many pushes give."""
    push = seeds.select("host", (F.col("mass") * (1 - damping)).alias("mass"))
    if rounds is not None:
        parts = [push, *pushed(push, edges, rounds, damping)]
    else:
        parts = [materialise(push.withColumn("last", F.col("mass")), "push")]
        # what all further pushes can add; it shrinks by `damping` each time at least
        while (parts[-1].agg(F.sum("last")).first()[0] or 0.0) * damping / (1 - damping) > tolerance:
            steps = pushed(parts[-1].where("last > 0").select("host", F.col("last").alias("mass")), edges, PUSHES, damping)
            marked = [x.select("host", "mass", (F.col("mass") if x is steps[-1] else F.lit(0.0)).alias("last")) for x in steps]
            both = reduce(DataFrame.unionByName, marked).groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("last").alias("last"))
            parts.append(materialise(both, "push"))
        parts = [x.select("host", "mass") for x in parts]
    return reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("mass").alias("score"))


def host_scores(pages: DataFrame, edges: DataFrame, rules=RULES, floor: float = FLOOR, rounds: int | None = ROUNDS) -> DataFrame:
    """host, trust, distrust, hosts (how many there are), blocked. `edges` should be a written table: each round reads it. `rounds` is that of the SQL; None sums the whole series."""
    rule = rule_of(F.col("host"), F.col("path"), rules)["verdict"]
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    known = seen.groupBy("host").agg(F.count_if(rule == "allow").alias("allowed"), F.count_if(rule == "block").alias("barred"))
    sums = known.agg(F.sum("allowed").alias("all_allowed"), F.sum("barred").alias("all_barred"), F.count("*").alias("hosts"))
    known = known.crossJoin(F.broadcast(sums))  # one row
    seeds = lambda n: known.where(f"{n} > 0").select("host", (F.col(n) / F.col(f"all_{n}")).alias("mass"))
    back = edges.groupBy("dst").agg(F.sum("weight").alias("total")).join(edges, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("total")).alias("weight"))
    if rounds is None:
        back = materialise(back, "back")
    trust = spread(seeds("allowed"), edges, rounds).withColumnRenamed("score", "trust")
    distrust = spread(seeds("barred"), back, rounds).withColumnRenamed("score", "distrust")
    scored = known.select("host", "hosts").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0)
    return scored.withColumn("blocked", (F.round("distrust", 12) > F.round("trust", 12)) & (F.round(F.col("distrust") * F.col("hosts"), 9) > floor))


def filter_urls(pages: DataFrame, scores: DataFrame, rules=RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`keep` columns, host, path, rule, verdict of every page; a name that `keep` has gets underscores before it."""
    named = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    blocked = materialise(scores.where("blocked").select("host", F.lit("block").alias("by_links")), "blocked")
    if blocked.count() <= SENT_HOSTS:
        blocked = F.broadcast(blocked)  # so pages of one host needn't meet
    found = rule_of(F.col("host"), F.col("path"), rules)
    made = {"host": F.col("host"), "path": F.col("path"), "rule": found["rule"], "verdict": F.coalesce(found["verdict"], "by_links", F.lit("allow"))}
    return named.join(blocked, "host", "left").select(*[F.col("kept").getField(c).alias(c) for c in keep], *[c.alias(fresh(n, list(keep))) for n, c in made.items()])
