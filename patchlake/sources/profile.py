"""Profiles of a dataset of images and masks, kept until the listing changes.

Of the training images (in the order of the split) every n-th is sampled; sizes come
from the listing, and pixels from the first bytes of the sampled images only. Totals are
extrapolated from the means. What is kept below a root, in versions: a digest of the
listing by folder, the profile, and the pixels of images read so far. With the same digest
the profile is given back and nothing is read; else only sampled images that are new, or
have another size or time, are read again.

Defined cases: no training images give zeros; a sampled stem without a file counts as
sampled and in no mean; unreadable images have no pixels; several files of one stem count
as the first by name; blank and repeated lines of the split are left out.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.digest import digest, merged, sums_of
from patchlake.functions.identity import stem
from patchlake.operators.ordered import totals_before
from patchlake.sources.files import image_files
from patchlake.sources.shared import materialise
from patchlake.sources.versions import commit, version

SAMPLE = 200
FIELDS = ("num_train", "num_val", "image_bytes_mean", "image_bytes_max", "mask_bytes_mean", "mask_bytes_max", "pixels_mean", "pixels_max", "sample_size")


def image_size(content: bytes) -> tuple[int, int] | None:
    """Height and width from the head of a PNG, JPEG, BMP, GIF or WebP; None if it has none."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack(">II", content[16:24])
        elif content[:2] == b"BM":
            w, h = struct.unpack("<ii", content[18:26])
        elif content[:4] == b"GIF8":
            w, h = struct.unpack("<HH", content[6:10])
        elif content[:4] == b"RIFF" and content[8:16] == b"WEBPVP8X":
            w, h = (int.from_bytes(content[i : i + 3], "little") + 1 for i in (24, 27))
        elif content[:4] == b"RIFF" and content[8:16] == b"WEBPVP8L":
            bits = int.from_bytes(content[21:25], "little")
            w, h = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif content[:4] == b"RIFF" and content[8:16] == b"WEBPVP8 ":
            w, h = (x & 0x3FFF for x in struct.unpack("<HH", content[26:30]))
        elif content[:2] == b"\xff\xd8":
            at = 2
            while True:
                mark, length = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
                if content[at] != 0xFF:
                    return None
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame's head
                    h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                    break
                at += 2 + length
        else:
            return None
    except (struct.error, IndexError):
        return None
    return (abs(h), w) if h and w > 0 else None


def pixel_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sizes = [image_size(c) if c is not None else None for c in b["content"]]
        yield b[["path", "bytes", "modified"]].assign(pixels=pd.array([s[0] * s[1] if s else None for s in sizes], "Int64"))


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """place, id: the lines of a split file, without blank ones; a missing file has none. One file is one small list."""
    folder, files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), None
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], "place bigint, id string")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("place", "id"))
    named = lines.select(F.col("place").cast("bigint").alias("place"), F.trim("id").alias("id")).where("id <> ''")
    return named.groupBy("id").agg(F.min("place").alias("place")).select("place", "id")


def stride_sample(train: DataFrame, sample: int) -> DataFrame:
    """The ids at places floor(i n / sample) for i below `sample`; all if there aren't more. train: place, id (a number, distinct)."""
    n = train.count()
    if n <= sample:
        return train.select("id")
    at = totals_before(train, "place", {"at": F.lit(1)})
    i = F.ceil(F.col("at") * sample / n)  # the only i whose place can be this one
    return at.where((i < sample) & (F.floor(i * n / sample) == F.col("at"))).select("id")


def first_of_stem(files: DataFrame) -> DataFrame:
    return files.groupBy(stem(F.col("path")).alias("id")).agg(F.min_by(F.struct("path", "bytes", "modified"), "path").alias("f")).select("id", "f.*")


def folder_digests(listing: DataFrame) -> DataFrame:
    """folder, n, s0 to s3 of each folder's files, which add up to the whole listing's. listing: path, bytes, modified."""
    line = F.concat_ws("|", "path", F.col("bytes").cast("string"), F.col("modified").cast("double").cast("string"))
    put = listing.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), line.alias("line"))
    return sums_of(put, F.col("line"), ("folder",))


def profile(spark: SparkSession, images: str, masks: str, train: str, val: str, root: str, sample: int = SAMPLE) -> dict:
    """The profile (FIELDS, and totals extrapolated), `read` (images whose heads were read now) and `changed` (folders). images, masks: folders; train, val: split files; root: where it is kept."""
    listed = materialise(image_files(spark, images).withColumn("kind", F.lit("image")).unionByName(image_files(spark, masks).withColumn("kind", F.lit("mask"))), "listed")
    ids, others = materialise(split_ids(spark, train), "train"), split_ids(spark, val)
    sums = materialise(folder_digests(listed), "sums")
    split = sums_of(ids.select(F.concat_ws("|", F.col("place").cast("string"), "id").alias("line")), F.col("line")).withColumn("folder", F.lit("split"))
    n_val = others.count()
    mark = merged(sums.unionByName(split.select(sums.columns))).select(F.sha2(F.concat_ws("|", F.lit(str(n_val)), F.lit(str(sample)), digest()), 256)).first()[0]
    now = version(spark, root)
    if now.get("mark") == mark:
        return now["profile"] | {"read": 0, "changed": 0}
    before = spark.read.parquet(f"{root}/{now['sums']}") if "sums" in now else sums.limit(0)
    changed = sums.join(before, sums.columns, "left_anti").count()
    picked = materialise(stride_sample(ids, sample), "picked")
    found = {k: picked.join(first_of_stem(listed.where(F.col("kind") == k)), "id") for k in ("image", "mask")}
    own = ["path", "bytes", "modified"]
    known = spark.read.parquet(f"{root}/{now['pixels']}") if "pixels" in now else None
    wanted = materialise(found["image"].select(*own), "wanted")
    fresh = wanted if known is None else wanted.join(known, own, "left_anti")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(images).select("path", "content")
    heads = fresh.join(content, "path").mapInPandas(pixel_counts, fresh.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",pixels:bigint")
    folder = f"pixels-{uuid.uuid4().hex}"
    kept = wanted.join(known, own) if known is not None else None
    (heads if kept is None else heads.unionByName(kept.select(heads.columns))).write.parquet(f"{root}/{folder}")
    sums_folder = f"sums-{uuid.uuid4().hex}"
    sums.write.parquet(f"{root}/{sums_folder}")
    whole = lambda c: F.coalesce(F.floor(c), F.lit(0)).cast("bigint")
    sized = lambda t, c, n: t.agg(whole(F.avg(c)).alias(f"{n}_mean"), whole(F.max(c)).alias(f"{n}_max")).first().asDict()
    out = {"num_train": ids.count(), "num_val": n_val, "sample_size": picked.count()}
    out |= sized(found["image"], "bytes", "image_bytes") | sized(found["mask"], "bytes", "mask_bytes") | sized(spark.read.parquet(f"{root}/{folder}"), "pixels", "pixels")
    out |= {"image_bytes_total": out["image_bytes_mean"] * out["num_train"], "mask_bytes_total": out["mask_bytes_mean"] * out["num_train"], "decoded_bytes_total": out["pixels_mean"] * 3 * out["num_train"], "decoded_bytes_max": out["pixels_max"] * 3}
    commit(spark, root, lambda base: base | {"mark": mark, "profile": out, "pixels": folder, "sums": sums_folder})
    return out | {"read": fresh.count(), "changed": changed}
