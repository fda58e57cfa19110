"""The stages one after the other on a small corpus, against what each should do."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patchlake.llm.bpe import coder


def prose(rng, n):
    words = "river stone under tree while bird sing summer day north country small old house garden window light evening".split()
    return " ".join(rng.choice(words) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    docs = [(i, prose(rng, rng.randint(40, 90)), "en", "web") for i in range(150)]
    item = prose(rng, 40)
    docs += [(200, docs[3][1], "en", "web"), (201, docs[4][1] + " end", "en", "web"), (202, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "web"), (203, "#%$ zq 99 ! " * 40, "en", "web"), (204, prose(rng, 400) + " mail jane.roe@example.com now", None, None), (205, None, "en", "web"), (206, "", "en", "web")]
    docs += [docs[7]]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120)] + [(203, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == columns, name
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["quality_classifier"] == set(range(150)) | {200, 201, 202, 204}
    assert kept["near_dedup"] == set(range(150)) | {202, 204}
    assert kept["benchmark_decontamination"] == kept["pii"] == kept["bpe"] == set(range(150)) | {204}
    assert docs.count() == 151  # a repeated row stays once
    masked = {r.doc_id: r for r in spark.read.parquet(f"{folder}/stage3").collect()}
    before = {r.doc_id: r for r in spark.read.parquet(f"{folder}/stage2").collect()}
    assert "jane.roe" not in masked[204].text and masked[204].text.endswith("@example.com now")
    assert all(masked[i].text == before[i].text for i in masked if i != 204)
    assert all(r.n_chars == len(r.text) for r in masked.values())
    import public_tokenizers

    own = coder(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.collect():
        assert r.round_trip and own.text(list(r.ids)) == masked[r.doc_id].text and r.n_tokens == len(r.ids)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() == 151
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"found": F.lit("f"), "kept": F.lit(1), "n": F.lit(2)})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/extra{k}")
        docs = spark.read.parquet(f"{folder}/extra{k}")
    assert docs.where("found = 'f' and kept = 1 and n = 2").count() == 151
