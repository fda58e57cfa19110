"""A corpus pipeline over `documents`: each stage calls one operator and hands on what it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm.bpe import encode, ids_digest
from patchlake.llm.common import fresh, materialise, scratch_path, sent, table
from patchlake.llm.decontaminate import decontaminate
from patchlake.llm.near_dedup import near_duplicates
from patchlake.llm.pii import EXAMPLE_KEY, pseudonymise
from patchlake.llm.quality_classifier import classify


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    found = fresh("found", docs.columns)
    out = classify(docs, table(spark, sf_dir, "labels"), into=found)
    return out.where(F.col(f"`{found}`.kept")).drop(found)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id; of rows with one doc_id and text, one."""
    groups = materialise(near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("doc_id is not null"), "groups")
    left = docs.join(sent(groups.where("not kept").select("doc_id")), "doc_id", "left_anti")
    repeated = sent(groups.where("kept and n > 1").select("doc_id"))  # only their texts are dealt out again
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others stay as they are."""
    found = fresh("found", docs.columns)
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), into=found)
    return out.where(~F.col(f"`{found}`.contaminated")).drop(found)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced by pseudonyms of their format; n_chars follows."""
    found = fresh("found", docs.columns)
    out = pseudonymise(docs, EXAMPLE_KEY, into=found)
    text = F.col(f"`{found}`.text")
    return out.withColumns({"text": text, "n_chars": F.char_length(text).cast("bigint")}).select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their number and digest, and whether they decode to the text again."""
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source", "text"], into="found")
    ids = F.col("found.ids")
    return out.select("doc_id", "lang", "source", ids.alias("ids"), F.size(ids).cast("bigint").alias("n_tokens"), ids_digest(ids).alias("ids_sha256"), F.col("found.decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("bpe", bpe),
]

#: Perplexity under a smoothed model, keyed permutations and BPE aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
