"""Two-dimensional maps of bank rows, seeded samples, and comparisons of feature sets.

Sums of rows and of their outer products are made in one pass over partitions
(D x D numbers each) and added up by Spark; only the D x D total, which doesn't
grow with the rows, is decomposed on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.operators.ordered import totals_before

SAMPLE, SEED = 800, 42
#: Percent that scores may move on average for two feature sets to be the same.
MAX_DRIFT = 0.05


def moments_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, total, outer = 0, 0.0, 0.0
    for b in batches:
        if len(b):
            x = np.array(b["vec"].tolist(), np.float64)
            n, total, outer = n + len(x), total + x.sum(axis=0), outer + x.T @ x
    if n:
        yield pd.DataFrame({"i": np.arange(len(total) + 1), "n": n, "x": [[float(n), *total], *([t, *o] for t, o in zip(total, outer, strict=True))]})


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of the vectors."""
    parts = rows.select("vec").mapInPandas(moments_of, "i int, n bigint, x array<double>")
    summed = parts.select("i", F.posexplode("x").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = summed.orderBy("i", "j").collect()  # (D + 1)^2 numbers
    if not found:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(len(found) ** 0.5)
    m = np.array([r["v"] for r in found]).reshape(d, d)
    return int(m[0, 0]), m[0, 1:], m[1:, 1:]


def signed(axes: np.ndarray) -> np.ndarray:
    """Each column so that its entry of largest size is positive."""
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def normal_axes(rows: DataFrame, dims: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (columns) and their percentages of the variance."""
    n, total, outer = moments(rows)
    if n < 2:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    mean = total / n
    values, vectors = np.linalg.eigh(outer / n - np.outer(mean, mean))
    order = np.argsort(-values)[:dims]
    return mean, signed(vectors[:, order]), 100 * values[order] / max(values.sum(), 1e-300)


def contrastive_axes(normal: DataFrame, anomalous: DataFrame, alpha: float = 1.0, dims: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes of the anomalous rows' spread about the normal mean, less alpha times the normal spread; anomalies lie on the positive side."""
    n, total, outer = moments(normal)
    m, other, other_outer = moments(anomalous)
    if n < 2 or m < 2:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    mean = total / n
    spread = other_outer / m - np.outer(other / m, mean) - np.outer(mean, other / m) + np.outer(mean, mean)
    values, vectors = np.linalg.eigh(spread - alpha * (outer / n - np.outer(mean, mean)))
    order = np.argsort(-values)[:dims]
    axes = vectors[:, order]
    side = (other / m - mean) @ axes
    return mean, axes * np.where(side < 0, -1, 1), values[order]


def placed(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The rows, without vec, and their places on the axes."""
    keep = [c for c in rows.columns if c != "vec"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = (np.array(b["vec"].tolist(), np.float64) - mean) @ axes
                yield b[keep].assign(**{n: at[:, i] for i, n in enumerate(names)})

    return rows.mapInPandas(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names]))


def projected(rows: DataFrame, mode: str = "auto", dims: int = 2) -> DataFrame:
    """rows (tier, vec, ...) on two axes: those of the anomalies (rows of the labelled tiers) if there are two and two normal ones, else of the normal rows; empty with fewer than two."""
    return placed(rows, *axes_for(rows, mode, dims=dims)[1:3]) if rows.where("tier = 'normal'").limit(2).count() > 1 else placed(rows.limit(0), np.zeros(0), np.zeros((0, dims)))


def axes_for(rows: DataFrame, mode: str = "auto", alpha: float = 1.0, dims: int = 2) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The mode that holds (normal or anomaly), mean, axes, and each axis's weight (percent of the variance, or eigenvalue)."""
    normal, odd = rows.where("tier = 'normal'"), rows.where("tier <> 'normal'")
    if mode != "normal" and odd.limit(2).count() > 1:
        return ("anomaly", *contrastive_axes(normal, odd, alpha, dims))
    return ("normal", *normal_axes(normal, dims))


def summed_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """entry, n, total of each batch."""
    for b in batches:
        if len(b):
            x = np.array(b["vec"].tolist(), np.float64)
            entries, where = np.unique(b["entry"].to_numpy(), return_inverse=True)
            total = np.zeros((len(entries), x.shape[1]))
            np.add.at(total, where, x)
            yield pd.DataFrame({"entry": entries, "n": np.bincount(where), "total": list(total)})


def mean_vectors(rows: DataFrame) -> DataFrame:
    """entry, vec: the mean of each entry's vectors; sums are made by batch before they are dealt out."""
    parts = rows.select(F.col("entry").cast("bigint").alias("entry"), "vec").mapInPandas(summed_vectors, "entry bigint, n bigint, total array<double>")
    summed = parts.select("entry", "n", F.posexplode("total").alias("i", "x")).groupBy("entry", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return summed.groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))


def image_vectors(bank: DataFrame, evaluations: DataFrame, top: int = 10) -> DataFrame:
    """tier, label, entry, vec, score: one vector for each image, the mean of its `top` hottest rows by its evaluation, or of all rows without one (and without a score). bank: tier, label, entry, row, vec; evaluations: tier, label, entry, top (score, row)."""
    own = ["tier", "label", "entry"]
    hot = evaluations.select(*own, F.slice("top", 1, top).alias("top")).where(F.size("top") > 0)
    known = bank.select(*own).distinct().join(hot, own, "left")
    wanted = known.where("top is not null").select(*own, F.explode("top").alias("t")).select(*own, F.col("t.row").alias("row"))
    rows = bank.join(wanted, [*own, "row"], "left_semi").unionByName(bank.join(known.where("top is null").select(*own), own, "left_semi"))
    score = F.aggregate("top", F.lit(0.0), lambda a, t: a + t["score"]) / F.size("top")
    return known.select(*own, score.alias("score")).join(mean_vectors(rows), "entry")


def own_axes(rows: DataFrame, moments_of_all: tuple, odd_moments: tuple, mode: str, alpha: float, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Each entry's rows on axes that were made without them: its own moments are taken from the sums. Axes point as the common ones do. rows: tier, entry, vec, ..."""
    keep = [c for c in rows.columns if c != "vec"]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["vec"].tolist(), np.float64)
        normal = group["tier"].iloc[0] == "normal"
        (n, total, outer), (m, other, other_outer) = moments_of_all, odd_moments
        if normal:
            n, total, outer = n - len(x), total - x.sum(axis=0), outer - x.T @ x
        else:
            m, other, other_outer = m - len(x), other - x.sum(axis=0), other_outer - x.T @ x
        at, own = mean, axes
        if n > 1 and (mode == "normal" or m > 1):
            at = total / n
            spread = outer / n - np.outer(at, at)
            if mode == "anomaly":
                spread = other_outer / m - np.outer(other / m, at) - np.outer(at, other / m) + np.outer(at, at) - alpha * spread
            values, vectors = np.linalg.eigh(spread)
            own = vectors[:, np.argsort(-values)[: axes.shape[1]]]
            own = own * np.where((own * axes).sum(axis=0) < 0, -1, 1)
        xy = (x - at) @ own
        return group[keep].assign(x=xy[:, 0], y=xy[:, 1])

    return rows.groupBy("entry").applyInPandas(place, T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in ("x", "y")]))


def projection(
    bank: DataFrame, evaluations: DataFrame | None = None, mode: str = "auto", granularity: str = "patch", per_tier: int = SAMPLE, guaranteed: int = 10, with_scores: bool = False, leave_own: bool = False, alpha: float = 1.0, k: int = 5, seed: int = SEED
) -> tuple[DataFrame, dict]:
    """Points (tier, label, entry, row, x, y, score) of a map of the bank, and what it says of itself: mode (normal, anomaly, empty), granularity, total and sampled by tier, guaranteed.

    Of each tier `per_tier` rows are shown, with each image's `guaranteed` hottest rows (by its
    evaluation) always among them; or, with the granularity `image`, one point for each image. Scores
    are of the points as shown: with `with_scores` the mean distance of a row to the k nearest normal
    rows of other images, for images that of their hottest rows. `leave_own` makes each image's axes
    without its rows. bank: tier, label, entry, row, vec. At most 3 x (per_tier + guaranteed x images)
    rows are shown; the axes' sums are D x D numbers.
    """
    from patchlake.operators.knn import nearest_mean
    from patchlake.sources.shared import materialise

    spark = bank.sparkSession
    none = spark.createDataFrame([], "tier string, label string, entry bigint, top array<struct<score:double,row:bigint>>")
    known = none if evaluations is None else evaluations
    count = lambda t: {r.tier: r["count"] for r in t.groupBy("tier").count().collect()}  # noqa: E731  three tiers
    info = {"granularity": granularity, "guaranteed": 0}
    if granularity == "image":
        shown = image_vectors(bank, known, guaranteed or 10).withColumn("row", F.lit(None).cast("bigint"))
        shown = materialise(shown.select("tier", "label", F.col("entry").cast("bigint").alias("entry"), "row", "vec", "score"), "shown")
        info["total"] = info["sampled"] = count(shown)
    else:
        rows = bank.select("tier", "label", F.col("entry").cast("bigint").alias("entry"), F.col("row").cast("bigint").alias("row"), "vec")
        hot = known.select("tier", "label", "entry", F.explode(F.slice("top", 1, max(1, guaranteed))).alias("t")).select("tier", "label", "entry", F.col("t.row").cast("bigint").alias("row")) if guaranteed else none.select("tier", "label", "entry", F.lit(0).cast("bigint").alias("row"))
        hot = materialise(hot.join(rows.select("tier", "label", "entry", "row"), ["tier", "label", "entry", "row"], "left_semi").distinct(), "hot")
        key = ("tier", "label", "entry", "row")
        parts = [seeded_sample(rows.where(F.col("tier") == t), max(2, per_tier), key, hot.where(F.col("tier") == t), seed) for t in ("normal", "critical", "negative")]
        shown = materialise(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("score", F.lit(None).cast("double")), "shown")
        info |= {"total": count(rows), "sampled": count(shown), "guaranteed": hot.count()}
    if info["sampled"].get("normal", 0) < 2:
        return spark.createDataFrame([], "tier string, label string, entry bigint, row bigint, x double, y double, score double"), info | {"mode": "empty"}
    held, mean, axes, weights = axes_for(shown, mode, alpha)
    info |= {"mode": held, "weights": weights.tolist()}
    if leave_own:
        at = own_axes(shown, moments(shown.where("tier = 'normal'")), moments(shown.where("tier <> 'normal'")), held, alpha, mean, axes)
    else:
        at = placed(shown, mean, axes)
    if granularity == "patch" and with_scores and info["total"].get("normal", 0) > 1:
        scores = nearest_mean(shown.select("tier", "label", "entry", "row", "vec"), bank.where("tier = 'normal'"), k, "entry", ["tier", "label", "entry", "row"])
        at = at.drop("score").join(scores, ["tier", "label", "entry", "row"], "left")
    return at.select("tier", "label", "entry", "row", "x", "y", "score"), info


def seeded_sample(rows: DataFrame, k: int, keys: tuple[str, ...], forced: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """k rows by a seeded hash of their keys; forced ones are always in, and count, even if there are more than k."""
    own = list(keys)
    must = rows.join(forced.select(*own), own, "left_semi") if forced is not None else rows.limit(0)
    left = max(0, k - must.count())
    rest = rows.join(forced.select(*own), own, "left_anti") if forced is not None else rows
    return must.unionByName(rest.orderBy(F.xxhash64(*own, F.lit(seed)), *own).limit(left))


def parity(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: the largest and mean relative L2 difference and the largest absolute one, and whether the first passes 0.005. Tables: id, vec."""
    both = one.select("id", F.col("vec").alias("a")).join(other.select("id", F.col("vec").alias("b")), "id")
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    gap = F.zip_with("a", "b", lambda x, y: x - y)
    rel = length(gap) / F.greatest(length(F.col("a")), F.lit(1e-12))
    out = both.agg(F.max(rel).alias("rel_max"), F.avg(rel).alias("rel_mean"), F.max(F.array_max(F.transform(gap, F.abs))).alias("abs_max"))
    return out.withColumn("passed", F.col("rel_max") <= 5e-3)


def scored_parity(one: DataFrame, other: DataFrame, bank: DataFrame, k: int = 10) -> DataFrame:
    """parity, and how far scores against a bank (entry, row, vec) move: drift_mean and drift_max in percent of the first table's score; it passes only if the mean is at most 0.05 too. Tables: id, vec."""
    from patchlake.operators.knn import nearest_mean

    score = lambda t, n: nearest_mean(t.select("id", "vec"), bank, k, "none", ["id"]).withColumnRenamed("score", n)
    moved = score(one, "a").join(score(other, "b"), "id")
    drift = F.abs(F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.lit(1e-9)) * 100
    found = moved.agg(F.avg(drift).alias("drift_mean"), F.max(drift).alias("drift_max"))
    both = parity(one, other).crossJoin(F.broadcast(found))  # a row each
    return both.withColumn("passed", F.col("passed") & (F.col("drift_mean") <= MAX_DRIFT))


def robust_scale(rows: DataFrame, value: str = "score") -> DataFrame:
    """lo, hi: the sorted values' elements at 5 and 95 percent, hi at least a little above lo; no row with fewer than two values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    put = totals_before(counted, "v", {"before": F.col("c")}).crossJoin(F.broadcast(counted.agg(F.sum("c").alias("n"))))  # one row
    at = lambda share: F.least(F.col("n") - 1, F.floor(F.col("n") * share))
    here = lambda share: (F.col("before") <= at(share)) & (at(share) < F.col("before") + F.col("c"))
    out = put.agg(F.max(F.when(here(0.05), F.col("v"))).alias("lo"), F.max(F.when(here(0.95), F.col("v"))).alias("hi"), F.max("n").alias("n")).where("n >= 2")
    return out.select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1e-6).alias("hi"))
