"""Scoring images in one go: distances to the normal rows and to each label's, composed into one score a row, and each image's summary.

Defined cases: without rows of a labelled tier its term is left out; rows of the image's own entry
can be left out of the bank; an image all of whose bank rows are left out has null scores; repeated
rows of an image are each scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.functions.scoring import composed, multiplier
from patchlake.operators.evaluation import attribution, image_stats, image_topk_mean, label_winners
from patchlake.operators.knn import label_nearest, nearest_mean
from patchlake.sources.shared import materialise

KEY = ("entry", "row")


def label_distances(rows: DataFrame, bank: DataFrame, leave_out: str = "none", weighted: bool = False, now: int = 0) -> DataFrame:
    """entry, row, tier, label, distance, nearest (the bank row's id): the nearest row of each label of the labelled tiers. bank: tier, label, entry, row, vec, id and, if weighted, severity, last_hit, memory."""
    named = bank.where("tier <> 'normal'").withColumn("label", F.concat_ws("/", "tier", "label"))
    if weighted:
        named = named.withColumn("weight", multiplier(F.col("severity"), F.lit(now), F.col("last_hit"), F.col("memory")))
    found = label_nearest(rows.select(*KEY, "vec"), named, leave_out, weighted, list(KEY))
    return found.select(*KEY, F.substring_index("label", "/", 1).alias("tier"), F.expr("substring(label, length(substring_index(label, '/', 1)) + 2)").alias("label"), "distance", "nearest")


def scored_images(rows: DataFrame, bank: DataFrame, k: int = 5, alpha: float = 0.0, beta: float = 0.0, leave_out: str = "none", weighted: bool = False, now: int = 0, top: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (entry, row, raw, critical, negative, score), images (entry, patches, score_max, score_mean, score_p99, topk), and each image's label winners with their share (entry, tier, label, distance, nearest, attribution)."""
    raw = nearest_mean(rows.select(*KEY, "vec"), bank.where("tier = 'normal'"), k, leave_out, list(KEY)).withColumnRenamed("score", "raw")
    labels = materialise(label_distances(rows, bank, leave_out, weighted, now), "labels")
    least = labels.groupBy(*KEY).agg(*[F.min(F.when(F.col("tier") == t, F.col("distance"))).alias(t) for t in ("critical", "negative")])
    scored = materialise(raw.join(least, list(KEY), "left").withColumn("score", composed(F.col("raw"), F.col("critical"), F.col("negative"), alpha, beta)), "scored")
    images = image_stats(scored).join(image_topk_mean(scored, ("entry",), "row", top), "entry")
    return scored, images, attribution(label_winners(labels, ("entry", "tier")), alpha, beta)
