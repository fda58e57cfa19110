"""Files as tables: images, masks, archives, saved arrays, and banks as partitioned tables in versions."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patchlake.functions.geometry import PATCH, WINDOW
from patchlake.functions.identity import base_name, has_image_extension, stem
from patchlake.functions.udtf import WindowOffsets
from patchlake.sources.versions import commit, version

IMAGE = "name string, bytes bigint, content binary"
VECTORS = "path string, row int, vec array<double>"


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, bytes, modified of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark, path).where(has_image_extension(F.col("name")))


def image_mask_pairs(spark: SparkSession, images: str, masks: str) -> DataFrame:
    """stem, image and mask (null without one) of each image."""
    left = image_files(spark, images).select(stem(F.col("path")).alias("stem"), F.col("path").alias("image"))
    right = listed(spark, masks).groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("mask"))
    return left.join(right, "stem", "left")


def zip_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members one by one, so a task holds one archive and one member."""
    for b in batches:
        for content in b["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in archive.infolist():
                    parts = info.filename.replace("\\", "/").split("/")
                    if info.is_dir() or "__MACOSX" in parts or parts[-1].startswith(".") or ".." in parts or parts[0] == "":
                        continue
                    yield pd.DataFrame({"name": [parts[-1]], "bytes": [info.file_size], "content": [archive.read(info)]})


def zipped_images(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, content of the images in zip archives: folders flattened, hidden files and names that leave the archive skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("content").mapInPandas(zip_members, IMAGE).where(has_image_extension(F.col("name")))


def decoded(images: DataFrame, decoder) -> tuple[DataFrame, DataFrame]:
    """Images with `height`, `width` from decoder(content) (None: undecodable), and the names of those that failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = [decoder(c) for c in b["content"]]
            yield pd.DataFrame({"name": b["name"], "height": pd.array([s[0] if s else None for s in shapes], "Int32"), "width": pd.array([s[1] if s else None for s in shapes], "Int32")})

    sized = images.select("name", "content").mapInPandas(run, "name string, height int, width int")
    return sized.where("height is not null"), sized.where("height is null").select("name")


def saved_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            array = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
            for at in range(0, len(array), 4096):
                part = array[at : at + 4096]
                yield pd.DataFrame({"path": path, "row": np.arange(at, at + len(part), dtype=np.int32), "vec": list(part)})


def saved_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, row, vec of the two-dimensional .npy files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(saved_rows, VECTORS)


def bank_directory(spark: SparkSession, path: str) -> DataFrame:
    """tier, label, row, vec of a bank saved as tier/label.npy, or as tier.npy for a tier without labels."""
    where = F.regexp_extract_all("path", F.lit(r"/(normal|critical|negative)(?:/([^/]+))?\.npy$"), F.lit(0))
    rows = saved_arrays(spark, path).where(F.size(where) > 0)
    tier = F.regexp_extract("path", r"/(normal|critical|negative)(?:/[^/]+)?\.npy$", 1)
    label = F.regexp_extract("path", r"/(?:critical|negative)/([^/]+)\.npy$", 1)
    return rows.select(tier.alias("tier"), F.when(tier == "normal", "").when(label == "", "_default").otherwise(label).alias("label"), "row", "vec")


def written_bank(bank: DataFrame, root: str) -> dict:
    folder = f"v-{uuid.uuid4().hex}"
    bank.write.partitionBy("tier", "label").parquet(f"{root}/{folder}")
    return {"bank": folder, "schema": bank.schema.jsonValue()}


def save_bank(bank: DataFrame, root: str) -> str:
    """Write a new version, partitioned by tier and label, whatever there was: readers see the old one or the new one, whole."""
    new = written_bank(bank, root)
    commit(bank.sparkSession, root, lambda base: base | new)
    return new["bank"]


def update_bank(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """Save change(bank); made again from the newest bank if another writer was faster, so no change is lost."""
    return commit(spark, root, lambda base: base | written_bank(change(bank_of(spark, root, base)), root))["bank"]


def bank_of(spark: SparkSession, root: str, now: dict) -> DataFrame:
    schema = StructType.fromJson(now["schema"])
    label = F.when(F.col("label") == "__HIVE_DEFAULT_PARTITION__", "").otherwise(F.coalesce("label", F.lit("")))
    return spark.read.schema(schema).parquet(f"{root}/{now['bank']}").withColumn("label", label).select(schema.names)


def load_bank(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest version, or one by its number."""
    return bank_of(spark, root, version(spark, root, number))


def export_package(bank: DataFrame, centroids: DataFrame | None, path: str) -> DataFrame:
    """Codes, scale and, if given, centroids as tables, and a one-row manifest, which is returned."""
    from patchlake.functions.scoring import quantised
    from patchlake.operators.clusters import dimension_scales, scale_vector

    scale = scale_vector(dimension_scales(bank))
    coded = bank.crossJoin(F.broadcast(scale)).withColumn("codes", quantised(F.col("vec"), F.col("scale"))).drop("vec", "scale")  # one row
    coded.write.partitionBy("tier").parquet(f"{path}/codes")
    scale.write.parquet(f"{path}/scale")
    if centroids is not None:
        centroids.write.parquet(f"{path}/centroids")
    manifest = bank.agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("dim"), F.lit(centroids is not None).alias("routed"))
    manifest.write.json(f"{path}/manifest")
    return bank.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


FEATURES = "entry bigint, row int, vec array<float>"


def window_rows(decode, encode, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One image at a time: mirrored up to a window, cut, encoded, rows in window order."""
    side = WINDOW // PATCH
    for b in batches:
        for entry, content in zip(b["entry"], b["content"], strict=True):
            image = decode(content)
            if image is None:
                continue
            pad = [(0, max(0, WINDOW - n)) for n in image.shape[:2]]
            image = np.pad(image, [*pad, *[(0, 0)] * (image.ndim - 2)], mode="reflect")
            for win, y, x in WindowOffsets().eval(*image.shape[:2]):
                vectors = np.asarray(encode(image[y : y + WINDOW, x : x + WINDOW]), np.float16).astype(np.float32)
                if len(vectors) != side * side:
                    raise ValueError(f"the encoder gave {len(vectors)} rows for a window, not {side * side}")
                yield pd.DataFrame({"entry": entry, "row": np.arange(len(vectors), dtype=np.int32) + win * side * side, "vec": list(vectors)})


def extracted(images: DataFrame, decode, encode) -> DataFrame:
    """entry, row, vec of images (entry, content): decode(bytes) gives an array or None, encode(window) a row for each of its patches."""
    return images.select("entry", "content").mapInPandas(partial(window_rows, decode, encode), FEATURES)


def import_bank(spark: SparkSession, source: str, root: str, needed: tuple[str, ...] = ("tier", "label", "row", "vec")) -> str:
    """Check a bank that was saved elsewhere and save it as this root's version: columns, known tiers, vectors of one length."""
    bank = load_bank(spark, source)
    missing = [c for c in needed if c not in bank.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    odd = bank.agg(F.count_if(~F.col("tier").isin("normal", "critical", "negative")).alias("tiers"), (F.max(F.size("vec")) != F.min(F.size("vec"))).alias("lengths")).first()
    if odd["tiers"] or odd["lengths"]:
        raise ValueError("unknown tiers, or vectors of several lengths")
    return save_bank(bank, root)
