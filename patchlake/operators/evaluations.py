"""Evaluations kept up to date: only images that changed are scored again.

An image's evaluation depends on its own rows and on the normal rows. Both have digests
that depend on no order, and are kept with the evaluation. `brought_up` scores the images
without a kept evaluation of both digests, keeps the others, drops those of images that
are gone, and commits the whole as a new version; so another writer's evaluations aren't
lost, and a crash leaves the old ones.

Defined cases: a change of any normal row makes all evaluations stale, as all scores may
change; images that moved to another tier or label are other images; an empty bank has no
evaluations; repeated rows count in the digests as often as they occur.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.digest import SUMS, digest, merged, sums_of
from patchlake.operators.evaluation import image_eval
from patchlake.operators.knn import nearest_mean
from patchlake.operators.memory import remove
from patchlake.sources.shared import materialise
from patchlake.sources.versions import commit, version

KEY = ("tier", "label", "entry")


def image_digests(bank: DataFrame, settings: str = "") -> DataFrame:
    """tier, label, entry, own, base: digests of an image's rows, and of all normal rows and the settings of the search."""
    line = F.concat_ws(":", F.col("row").cast("string"), F.hex(F.xxhash64("vec")), F.hex(F.xxhash64(F.lit(1), "vec")))
    sums = materialise(sums_of(bank.select(*KEY, line.alias("line")), F.col("line"), KEY), "sums")
    base = merged(sums.where("tier = 'normal'").select(*SUMS)).select(F.sha2(F.concat(F.lit(settings), digest()), 256).alias("base"))
    return sums.select(*KEY, digest().alias("own")).crossJoin(F.broadcast(base))  # one row


def scored(bank: DataFrame, images: DataFrame, k: int = 5) -> DataFrame:
    """The images' statistics: their rows against the normal rows of other images."""
    rows = bank.join(images.select(*KEY), list(KEY), "left_semi")
    scores = nearest_mean(rows, bank.where("tier = 'normal'"), k, "entry", [*KEY, "row"])
    return image_eval(materialise(scores, "scores"), KEY)


def kept(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The evaluations of a version; None if there's none."""
    now = version(spark, root, number)
    return spark.read.parquet(f"{root}/{now['evaluations']}") if "evaluations" in now else None


def brought_up(bank: DataFrame, root: str, k: int = 5, settings: str = "") -> dict[str, int]:
    """Evaluate what isn't evaluated; how many evaluations were kept, scored and purged. bank: tier, label, entry, row, vec. Each row says in `since` which version scored it."""
    spark, counts = bank.sparkSession, {}
    images = materialise(image_digests(bank, f"{settings}|{k}"), "images")

    def change(base: dict) -> dict | None:
        held = kept(spark, root, base["number"]) if base["number"] else None
        own = [*KEY, "own", "base"]
        still = held.join(images, own, "left_semi").select(held.columns) if held is not None else None
        todo = images if held is None else images.join(held, own, "left_anti")
        new = scored(bank, todo, k).join(todo, list(KEY)).withColumn("since", F.lit(base["number"] + 1).cast("bigint"))
        folder = f"evaluations-{uuid.uuid4().hex}"
        (new if still is None else still.unionByName(new.select(held.columns))).write.parquet(f"{root}/{folder}")
        done = spark.read.parquet(f"{root}/{folder}").agg(F.count("*").alias("n"), F.count_if(F.col("since") == base["number"] + 1).alias("new")).first()
        counts.update(kept=done.n - done.new, scored=done.new, purged=(held.count() if held is not None else 0) - (done.n - done.new))
        if held is not None and not counts["scored"] and not counts["purged"]:
            return None
        return base | {"evaluations": folder}

    commit(spark, root, change)
    return counts


def without_images(bank: DataFrame, evaluations: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bank and evaluations without the images (entry). If a normal image goes no evaluation holds any more."""
    gone = images.select("entry").distinct()
    any_normal = bank.where("tier = 'normal'").join(gone, "entry", "left_semi").agg((F.count("*") > 0).alias("normal"))
    left = evaluations.join(gone, "entry", "left_anti").crossJoin(F.broadcast(any_normal)).where("not normal").drop("normal")  # one row
    return remove(bank, gone), left.select(evaluations.columns)
