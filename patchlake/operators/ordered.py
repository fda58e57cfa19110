"""Running totals over a whole table without one task that sorts all of it.

The order column is cut at approximate quantiles into buckets; equal values lie
in one bucket and are added up before. Each bucket is a window of its own, and
what lies before it comes from one small row for each bucket (at most `BUCKETS`
for each key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512


def bucketed(df: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """A column `__bucket` that grows with the order column."""
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("c")).first()["c"] or []
    cuts = sorted({float(c) for c in cuts})  # at most `buckets` numbers
    if not cuts:
        return df.withColumn("__bucket", F.lit(0))
    limits = F.array(*[F.lit(c) for c in cuts])
    return df.withColumn("__bucket", F.size(F.filter(limits, lambda c: c < F.col(order))))


def totals_before(df: DataFrame, order: str, sums: dict[str, Column], keys: tuple[str, ...] = (), kind: str = "sum", buckets: int = BUCKETS) -> DataFrame:
    """The columns and, for each name in `sums`, the sum (or max) of its column over rows of the keys with a smaller order value.

    Rows should be distinct by keys and order, as sums by value are.
    """
    fold = F.max if kind == "max" else F.sum
    put = bucketed(df.withColumns({f"__{n}": c for n, c in sums.items()}), order, buckets)
    whole = put.groupBy(*keys, "__bucket").agg(*[fold(f"__{n}").alias(f"__b{n}") for n in sums])
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "__bucket", *[fold(f"__b{n}").over(before).alias(f"__b{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = put.withColumns({f"__i{n}": fold(f"__{n}").over(inside) for n in sums}).join(whole, [*keys, "__bucket"])
    if kind == "max":
        return out.select(*df.columns, *[F.greatest(f"__i{n}", f"__b{n}").alias(n) for n in sums])
    return out.select(*df.columns, *[(F.coalesce(f"__i{n}", F.lit(0)) + F.coalesce(f"__b{n}", F.lit(0))).alias(n) for n in sums])


def merged_intervals(df: DataFrame, start: str = "start", count: str = "count", limit: Column | None = None) -> DataFrame:
    """start, count of the islands of intervals that overlap or touch, clipped to [0, limit) and without empty ones."""
    low, high = F.greatest(F.col(start), F.lit(0)), F.col(start) + F.col(count)
    high = high if limit is None else F.least(high, limit)
    spans = df.select(low.alias("low"), high.alias("high")).where("high > low").groupBy("low").agg(F.max("high").alias("high"))
    reached = totals_before(spans, "low", {"reached": F.col("high")}, kind="max")
    opened = reached.withColumn("opens", F.coalesce(F.col("low") > F.col("reached"), F.lit(True)).cast("int"))
    numbered = totals_before(opened, "low", {"before": F.col("opens")})
    return numbered.groupBy((F.col("before") + F.col("opens")).alias("island")).agg(F.min("low").alias("start"), (F.max("high") - F.min("low")).alias("count")).drop("island")
