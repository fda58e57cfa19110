"""Connected components over links in Spark, by alternating large-star and small-star steps.

Defined cases: no links give no rows; repeated links, both directions and
self-links are allowed; nulls are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.common import materialise


def large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to its smallest one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest one. Links lead from a to a smaller b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every linked id that isn't the smallest itself. Links: a, b."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, was = materialise(now, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        now, was = materialise(small_star(large_star(now)), "links"), mark
