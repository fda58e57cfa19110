"""Columns of the input whose names clash with those that operators use or make."""

import public_tokenizers
import pytest

from patchlake.llm import bpe, decontaminate, html_extraction, near_dedup, pii, quality_classifier, quality_rules, token_counts, url_filters, warc

NAMES = ["a", "b", "a0", "b0", "__l", "__text", "host", "verdict", "x.y", "found", "kept", "key", "result", "n_words", "n_tokens", "fold", "low", "digest", "row", "node"]


@pytest.fixture(scope="module")
def rows(spark):
    text = "a small river runs over many stones and under old trees while birds sing of long summer days in the north country"
    data = [(i, t, "en", t, f"http://h{i}.example/p", *range(len(NAMES))) for i, t in enumerate([text, text + " again", "short", "", None])]
    own = ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame(data, f"doc_id bigint, text string, lang string, html string, url string, {own}").withColumnRenamed("doc_id", "page_id").selectExpr("page_id as doc_id", "*")


def whole(out, keep):
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 5 and all(got[i][n] == k for i in got for k, n in enumerate(NAMES))
    assert out.columns[: len(keep)] == keep and len(set(out.columns)) == len(out.columns) > len(keep)


OPERATORS = {
    "op1": lambda d, keep: quality_rules.quality_rules(d, keep=tuple(keep)),
    "op4": lambda d, keep: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json"), keep=tuple(keep)),
    "op5": lambda d, keep: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, "river runs over")], "item_id bigint, text string"), keep=keep),
    "op6": lambda d, keep: html_extraction.extract(d, keep=keep),
    "op7": lambda d, keep: quality_classifier.classify(d, d.sparkSession.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int"), keep=keep),
    "op8": lambda d, keep: pii.pseudonymise(d, b"k", keep=keep),
    "op9": lambda d, keep: url_filters.filter_urls(d, url_filters.host_scores(d, url_filters.host_edges(d)), keep=tuple(keep)),
    "op10": lambda d, keep: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.json"), keep=keep),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_kept_columns(rows, name):
    keep = ["doc_id", *NAMES]
    whole(OPERATORS[name](rows, keep), keep)


def test_ignored_columns(spark, rows):
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(rows).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    root = warc.new_root(spark)
    assert warc.read_warc(warc.write_warc(rows, root), root).count() == 5
