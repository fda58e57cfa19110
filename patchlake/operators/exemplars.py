"""Exemplars: the rows that stand for known defects, and distances to those of other images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.operators.evaluation import top_rows
from patchlake.operators.knn import nearest_mean


def exemplar_rows(rows: DataFrame, scores: DataFrame, auto_top: int = 10) -> DataFrame:
    """Heavy rows of annotated images and the hottest rows of the others; none of images never scored. rows: entry, row, severity, annotated, ...; scores: entry, row, score."""
    hottest = top_rows(scores, ("entry",), "row", auto_top).select("entry", "row")
    return rows.where("annotated and severity = 3").unionByName(rows.where("not annotated").join(hottest, ["entry", "row"], "left_semi"))


def exemplar_distances(hot: DataFrame, exemplars: DataFrame) -> DataFrame:
    """The columns of `hot` but vec, and cmin: distance to the nearest exemplar of another image; rows without one go. hot: entry, vec, ..."""
    keep = [c for c in hot.columns if c != "vec"]
    return nearest_mean(hot, exemplars.select("entry", "row", "vec"), 1, "entry", keep).where("score is not null").withColumnRenamed("score", "cmin")


def live_evaluations(cached: DataFrame, members: DataFrame, key: tuple[str, ...] = ("tier", "label", "entry")) -> DataFrame:
    """Cached statistics of images that are still members."""
    return cached.join(members.select(*key).distinct(), list(key), "left_semi")


def orphaned_evaluations(cached: DataFrame, members: DataFrame, key: tuple[str, ...] = ("tier", "label", "entry")) -> DataFrame:
    return cached.join(members.select(*key).distinct(), list(key), "left_anti")


def newest(log: DataFrame, cap: int, order: tuple[str, ...] = ("ts", "id"), by: tuple[str, ...] = ()) -> DataFrame:
    """The newest `cap` records of each key, or of all: a top-k, for which no task sorts the whole log."""
    if not by:
        return log.orderBy(*[F.desc(c) for c in order]).limit(cap)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")
