"""The operators' queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm.bpe import encode, ids_digest
from patchlake.llm.collocations import collocations, ranked
from patchlake.llm.common import materialise, sent, table
from patchlake.llm.decontaminate import decontaminate
from patchlake.llm.html_extraction import extract
from patchlake.llm.mixing import mix
from patchlake.llm.near_dedup import near_duplicates
from patchlake.llm.pii import EXAMPLE_KEY, pseudonymise
from patchlake.llm.quality_classifier import classify
from patchlake.llm.quality_rules import quality_rules
from patchlake.llm.token_counts import count_tokens
from patchlake.llm.url_filters import filter_urls, host_edges, host_scores
from patchlake.llm.vector_codes import books_digest, codebooks, compress
from patchlake.llm.warc import new_root, read_warc, write_warc


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), keep=("doc_id",), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_root(spark)
    out = read_warc(write_warc(table(spark, sf_dir, "pages"), root), root)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id",))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.sha2(F.concat_ws(",", "found.items"), 256)
    return out.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"), items.alias("items_sha256"), "found.contaminated")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "found.text", "found.n_chars")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return out.select("doc_id", "lang", "found.*")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), EXAMPLE_KEY, keep=["doc_id"])
    kinds = F.concat_ws(",", F.array_sort(F.col("found.spans.kind")))
    return out.select("doc_id", "found.n_spans", kinds.alias("kinds"), "found.text")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    edges = materialise(host_edges(pages), "edges")
    return filter_urls(pages, host_scores(pages, edges, rounds=None))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    ids = F.col("found.ids")
    return out.select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"), ids_digest(ids).alias("ids_sha256"), F.sha2("found.decoded", 256).alias("decoded_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranked(collocations(table(spark, sf_dir, "documents")))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = codebooks(vectors)
    if books is None:
        return vectors.where("false").selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    codes = materialise(compress(vectors, books, keep=["vec_id", "label"]), "codes")
    code = F.lower(F.concat_ws("", F.transform("codes", lambda x: F.lpad(F.hex(x), 2, "0"))))
    labels = materialise(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    out = codes.join(sent(labels), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good weigh 2, bad 0.5, others 1."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weights = labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))
    return mix(table(spark, sf_dir, "documents"), weights, keep=["doc_id"])


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_near_dedup, op3_warc, op4_token_counts, op5_decontaminate, op6_html_extraction, op7_quality_classifier, op8_pii, op9_url_filters, op10_bpe, op11_collocations, op12_vector_codes, op13_mixing)}
