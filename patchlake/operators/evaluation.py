"""Image statistics and how well they separate good from bad: AUROC, thresholds, sweeps, histograms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions.scoring import stat_with_alpha
from patchlake.operators.ordered import totals_before
from patchlake.sources.shared import materialise

TOP = 256
#: Pixels that a task makes together.
PIXELS = 1 << 18


def image_eval(scores: DataFrame, by: tuple[str, ...] = ("entry",), row: str = "row", top: int = TOP) -> DataFrame:
    """`by`, patches, score_max, score_mean, score_p99 (interpolated) and top: the highest scores with their rows. scores: by, row, score."""
    return (
        top_rows(scores, by, row, top)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(row).alias("r")))).alias("t"))
        .select(*by, F.transform("t", lambda x: F.struct((-x["s"]).alias("score"), x["r"].alias("row"))).alias("top"))
        .join(image_stats(scores, by), list(by))
    )


def image_stats(scores: DataFrame, by: tuple[str, ...] = ("entry",)) -> DataFrame:
    return scores.groupBy(*by).agg(F.count("*").alias("patches"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean"), F.percentile("score", 0.99).alias("score_p99"))


def top_rows(scores: DataFrame, by: tuple[str, ...], row: str, k: int, score: str = "score") -> DataFrame:
    """The k highest scores of each group, ties to the smaller row."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(row)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def image_topk_mean(scores: DataFrame, by: tuple[str, ...], row: str, k: int, score: str = "score") -> DataFrame:
    return top_rows(scores, by, row, k, score).groupBy(*by).agg(F.avg(score).alias("topk"))


def by_value(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, v, p, n: how many positives and negatives have each value. rows: keys, v, positive."""
    return rows.groupBy(*keys, "v").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))


def auroc(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and auroc: the share of pairs in the right order, ties half; NaN without positives or negatives. rows: keys, v, positive."""
    counted = totals_before(by_value(rows, keys), "v", {"below": F.col("n")}, keys)
    sums = counted.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("auroc"))


def youden(rows: DataFrame) -> DataFrame:
    """threshold and j: the midpoint of neighbours in the sorted values with the largest tpr - fpr; the first of equals (to 12 digits).

    Equal neighbours make a midpoint of their own value, so both the values that
    repeat and the midpoints between different values are candidates.
    """
    counted = materialise(totals_before(by_value(rows), "v", {"p0": F.col("p"), "n0": F.col("n")}), "counted")
    sums = counted.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.count("*").alias("values"))
    put = next_value(counted).crossJoin(F.broadcast(sums))  # one row
    upto_p, upto_n = F.col("p0") + F.col("p"), F.col("n0") + F.col("n")
    j = (F.col("all_p") - upto_p) / F.col("all_p") - (F.col("all_n") - upto_n) / F.col("all_n")
    same = put.where(F.col("p") + F.col("n") > 1).select(F.col("v").alias("m"), j.alias("j"), F.lit(0).alias("order"), "v")
    between = put.where("following is not null").select(((F.col("v") + F.col("following")) / 2).alias("m"), j.alias("j"), F.lit(1).alias("order"), "v")
    best = same.unionByName(between).agg(F.max_by(F.struct("m", "j"), F.struct(F.round("j", 12), (-F.col("v")).alias("a"), (-F.col("order")).alias("b"))).alias("x"))
    least = counted.agg(F.min("v").alias("least"))
    return best.crossJoin(F.broadcast(least)).select(F.coalesce("x.m", "least").alias("threshold"), F.col("x.j").alias("j"))  # one row each


def next_value(counted: DataFrame) -> DataFrame:
    """Each distinct value with the next larger one."""
    down = totals_before(counted.select((-F.col("v")).alias("w")), "w", {"next": F.col("w")}, kind="max")
    return counted.join(down.select((-F.col("w")).alias("v"), (-F.col("next")).alias("following")), "v")


def best_k(evals: DataFrame, most: int = TOP, rounded: int = 12) -> DataFrame:
    """k, auroc of the first best k of 1..most; statistics equal to `rounded` digits are ties. evals: positive, top (scores from the largest)."""
    each = evals.select("positive", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), "top").where(F.size("top") > 0)
    mean = F.aggregate(F.slice("top", 1, F.col("k")), F.lit(0.0), lambda a, x: a + x) / F.least("k", F.size("top"))
    scored = auroc(each.select("k", F.round(mean, rounded).alias("v"), "positive"), ("k",))
    return scored.agg(F.max_by(F.struct("k", "auroc"), F.struct(F.round("auroc", 12), -F.col("k"))).alias("x")).select("x.k", "x.auroc")


def alpha_sweep(evals: DataFrame, kind: str = "topk", k: int = 10, most: int = 200, step: int = 5, digits: int = 12) -> DataFrame:
    """alpha, auroc, margin for alpha from 0 to `most`; statistics equal to so many digits are ties. evals: tier, top, cmin, patches, score_p99, score_max."""
    each = evals.where("tier in ('normal', 'critical')").withColumn("alpha", F.explode(F.sequence(F.lit(0), F.lit(most), F.lit(step))))
    value = stat_with_alpha(F.col("top"), F.col("cmin"), F.col("patches"), F.col("score_p99"), F.col("score_max"), kind, k, F.col("alpha").cast("double"))
    rows = materialise(each.select("alpha", F.round(value, digits).alias("v"), (F.col("tier") == "critical").alias("positive")), "sweep")
    ng, ok = F.when(F.col("positive"), F.col("v")), F.when(~F.col("positive"), F.col("v"))
    ends = rows.groupBy("alpha").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(ng).alias("ng"), F.max(ok).alias("ok"))
    margin = F.when(F.col("hi") > F.col("lo"), (F.col("ng") - F.col("ok")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(float("-inf")))
    return auroc(rows, ("alpha",)).join(ends.select("alpha", margin.alias("margin")), "alpha")


def best_alpha(swept: DataFrame) -> tuple[int, float, float]:
    """The sweep's rows (41 at most) in order: a higher AUROC wins, and of equal ones (to 1e-9) the higher margin."""
    best = (0, -1.0, float("-inf"))
    for r in swept.orderBy("alpha").limit(1000).collect():
        if r["auroc"] > best[1] + 1e-9 or abs(r["auroc"] - best[1]) <= 1e-9 and r["margin"] > best[2]:
            best = r["alpha"], r["auroc"], r["margin"]
    return best


def upper_median(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and the element at n // 2 of the sorted values (`value`)."""
    return element_at_share(rows, value, lambda n: F.floor(n / 2), keys)


def element_at_share(rows: DataFrame, value: str, at, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and the sorted values' element at `at`(n), from 0."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = totals_before(counted, "v", {"before": F.col("c")}, keys)
    sizes = counted.groupBy(*keys).agg(F.sum("c").alias("n"))
    both = placed.join(sizes, list(keys)) if keys else placed.crossJoin(F.broadcast(sizes))  # one row
    place = at(F.col("n"))
    return both.where((F.col("before") <= place) & (place < F.col("before") + F.col("c"))).select(*keys, F.col("v").alias(value))


def separation(values: DataFrame, threshold: DataFrame) -> DataFrame:
    """One row: images by tier, misses and false alarms at the threshold. values: tier, v; threshold: one row."""
    put = values.crossJoin(F.broadcast(threshold.select("threshold")))  # one row
    over = F.col("v") > F.col("threshold")
    normal, critical = F.col("tier") == "normal", F.col("tier") == "critical"
    return put.agg(
        F.count_if(normal).alias("n_ok"), F.count_if(critical).alias("n_ng"), F.count_if(F.col("tier") == "negative").alias("n_negative"),
        F.count_if(critical & ~over).alias("misses"), F.count_if(normal & over).alias("false_alarms"), F.any_value("threshold").alias("threshold"),
    )


def histogram(values: DataFrame, bins: int = 48) -> DataFrame:
    """bin and the number of values of each tier in it, empty bins too; equal bins over the whole range, of width 1/bins if that is empty."""
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)).alias("span"))
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("lo")) / F.col("span") * bins))).cast("int")
    counted = values.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("normal", "critical", "negative")])  # one row
    return values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").na.fill(0)


def by_image(cells: DataFrame) -> DataFrame:
    """Cells dealt out by image once, for all groupings and joins by image that follow."""
    return cells.repartition("image")


def grid_merge(cells: DataFrame, height: Column, width: Column) -> DataFrame:
    """image, gy, gx, score: the largest score of overlapping windows in each cell; cells without one take the image's mean.

    cells: image, gy, gx, score and what `height` and `width` (cells of the grid) are made from.
    """
    sized = cells.select("image", "gy", "gx", "score", height.cast("bigint").alias("h"), width.cast("bigint").alias("w"))
    merged = by_image(sized).groupBy("image", "gy", "gx").agg(F.max("score").alias("score"), F.max("h").alias("h"), F.max("w").alias("w"))
    image = merged.groupBy("image").agg(F.avg("score").alias("mean"), F.max("h").alias("h"), F.max("w").alias("w"), F.collect_list(F.struct("gy", "gx", "score")).alias("c"))
    inside = F.filter("c", lambda x: (x["gy"] >= 0) & (x["gy"] < F.col("h")) & (x["gx"] >= 0) & (x["gx"] < F.col("w")))
    put = image.withColumn("c", F.array_sort(F.transform(inside, lambda x: F.struct((F.col("w") * x["gy"] + x["gx"]).alias("place"), x["score"].alias("score")))))
    # each cell with a score, and the ones without up to the next; first those before all
    end = (F.col("h") * F.col("w")).alias("place")
    starts = F.concat(F.array(F.struct(F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast(merged.schema["score"].dataType).alias("score"))), "c")
    ends = F.concat(F.transform("c", lambda x: x["place"]), F.array(end))
    runs = put.select("image", "mean", "w", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("r"))
    each = runs.select("image", "mean", "w", F.col("r.a.place").alias("own"), "r.a.score", F.greatest(F.col("r.a.place"), F.lit(0)).alias("from"), (F.col("r.b") - 1).alias("to")).where("to >= from")
    out = each.select("image", "mean", "w", "own", "score", F.explode(F.sequence("from", "to")).alias("place"))
    score = F.coalesce(F.when(F.col("place") == F.col("own"), F.col("score")), "mean")
    return out.select("image", F.floor(F.col("place") / F.col("w")).alias("gy"), (F.col("place") % F.col("w")).alias("gx"), score.alias("score"))


def label_winners(nearest: DataFrame, by: tuple[str, ...] = ("entry",)) -> DataFrame:
    """by, label, distance, nearest: each label's smallest distance; the first window and patch of equals. nearest: by, row, label, distance, nearest."""
    best = F.min(F.struct("distance", "row", "nearest")).alias("b")
    return nearest.groupBy(*by, "label").agg(best).select(*by, "label", F.col("b.distance").alias("distance"), F.col("b.nearest").alias("nearest"))


def attribution(winners: DataFrame, alpha: float, beta: float) -> DataFrame:
    """The winners with attribution: alpha (critical) or beta (negative) over 1 + distance; coefficients of 0 count as 1."""
    strength = F.when(F.col("tier") == "critical", F.lit(alpha or 1.0)).otherwise(F.lit(beta or 1.0))
    return winners.withColumn("attribution", strength / (1 + F.col("distance")))


def pixels_of(cell: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pixels of each image: bilinear between cell centres, the edge repeated beyond them, cropped to the image. Images of one shape are made together."""

    def axis(size: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) / cell - 0.5, 0, cells - 1)
        low = np.minimum(at.astype(int), max(cells - 2, 0))
        return low, np.minimum(low + 1, cells - 1), at - low

    for b in batches:
        image, height, width = (b.column(n).to_numpy(zero_copy_only=False) for n in ("image", "height", "width"))
        gy, gx, score = (b.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("gy", "gx", "score"))
        cells = b.column("gy").value_lengths().to_numpy(zero_copy_only=False)
        if not len(image):
            continue
        owner, starts = np.repeat(np.arange(len(image)), cells), np.cumsum(cells) - cells
        shape = np.stack([height, width, np.maximum.reduceat(gy, starts) + 1, np.maximum.reduceat(gx, starts) + 1], axis=1)
        shapes, kind = np.unique(shape, axis=0, return_inverse=True)
        order = np.argsort(kind, kind="stable")
        cell_order = np.argsort(kind[owner], kind="stable")
        ends, cell_ends = np.cumsum(np.bincount(kind)), np.cumsum(np.bincount(kind[owner]))
        for (h, w, grid_h, grid_w), last, n, cell_last, m in zip(shapes.tolist(), ends, np.bincount(kind), cell_ends, np.bincount(kind[owner]), strict=True):
            mine, own = order[last - n : last], cell_order[cell_last - m : cell_last]
            grid = np.zeros((n, grid_h, grid_w))
            grid[np.searchsorted(mine, owner[own]), gy[own], gx[own]] = score[own]
            (y0, y1, fy), (x0, x1, fx) = axis(h, grid_h), axis(w, grid_w)
            step = max(1, PIXELS // max(1, h * w))
            for i in range(0, n, step):
                some = grid[i : i + step]
                wide = some[:, :, x0] * (1 - fx) + some[:, :, x1] * fx
                full = wide[:, y0] * (1 - fy)[:, None] + wide[:, y1] * fy[:, None]
                rows = len(some) * h
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(w)), pa.array(full.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(image[mine[i : i + step]], h)), pa.array(np.tile(np.arange(h, dtype=np.int32), len(some))), lists], ["image", "y", "scores"])


def grid_to_pixels(grid: DataFrame, cell: int = 14) -> DataFrame:
    """image, y, scores: a heat map's pixel rows. grid: image, gy, gx, score, height, width; an image's cells are one row, and bounded."""
    cells = F.array_sort(F.collect_list(F.struct("gy", "gx", "score")))
    put = grid.groupBy(F.col("image").cast("bigint").alias("image")).agg(F.max("height").cast("int").alias("height"), F.max("width").cast("int").alias("width"), cells.alias("c"))
    return put.select("image", "height", "width", F.col("c.gy").cast("array<bigint>").alias("gy"), F.col("c.gx").cast("array<bigint>").alias("gx"), F.col("c.score").cast("array<double>").alias("score")).mapInArrow(partial(pixels_of, cell), "image bigint, y int, scores array<double>")
