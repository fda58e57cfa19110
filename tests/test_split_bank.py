"""Metadata that change while vectors stay, and joins without a shuffle."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from patchlake.operators import memory
from patchlake.sources.split_bank import SplitBank
from patchlake.sources.versions import version

SCHEMA = "tier string, label string, entry bigint, row bigint, vec array<double>, severity int, registered_at bigint, last_hit bigint, hit_count bigint, memory int"


def bank_of(spark):
    rows = [(t, "" if t == "normal" else f"d{e % 2}", e, r, [float(e), float(r)], 1 + r % 3, 0, e * 10, r, r % 2) for e in range(30) for t in [("normal", "critical", "negative")[e % 3]] for r in range(4)]
    return spark.createDataFrame(rows, SCHEMA)


def files(root, folder):
    return {p.name: p.stat().st_mtime_ns for p in Path(root, folder).glob("*.parquet")}


def test_changes_write_metadata_only(spark, tmp_path):
    root, bank = f"{tmp_path}/bank", bank_of(spark)
    split = SplitBank.create(bank, root, buckets=3)
    now = version(spark, root)
    before = files(root, now["vectors"])
    assert len(before) == 3
    hits = bank.where("tier <> 'normal' and row < 2").select(*memory.KEY)
    split.change(lambda m: memory.hit(m, hits, 500))
    split.change(lambda m: memory.decay(m, 500))
    want = memory.decay(memory.hit(bank, hits, 500), 500)
    got = split.rows().select(bank.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() < bank.count()
    assert files(root, now["vectors"]) == before and version(spark, root)["vectors"] == now["vectors"]
    assert sorted(map(str, split.rows(1).select(bank.columns).collect())) == sorted(map(str, bank.collect()))
    split.compact()
    assert spark.read.parquet(f"{root}/{version(spark, root)['vectors']}").count() == want.count()
    assert sorted(map(str, split.rows().select(bank.columns).collect())) == sorted(map(str, want.collect()))


def test_the_join_shuffles_nothing(spark, tmp_path):
    split = SplitBank.create(bank_of(spark), f"{tmp_path}/bank", buckets=3)
    plan = split.rows()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"\bExchange\b", plan)


def test_another_session_opens_it(spark, tmp_path):
    root = f"{tmp_path}/bank"
    split = SplitBank.create(bank_of(spark), root, buckets=2)
    for folder in (version(spark, root)[k] for k in ("vectors", "meta")):
        spark.sql(f"drop table {split.table_name(folder)}")
    other = SplitBank(spark, root)
    assert other.rows().count() == 120
    plan = other.rows()._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bExchange\b", plan)


def test_two_writers_and_wrong_changes(spark, tmp_path):
    split = SplitBank.create(bank_of(spark), f"{tmp_path}/bank", buckets=2)
    runs = []

    def slow(meta):
        if not runs:
            split.change(lambda m: m.withColumn("hit_count", F.col("hit_count") + 100))
        runs.append(1)
        return meta.withColumn("hit_count", F.col("hit_count") * 2)

    split.change(slow)
    assert len(runs) == 2 and {r.hit_count for r in split.meta().select("hit_count").distinct().collect()} == {200, 202, 204, 206}
    with pytest.raises(ValueError, match="doesn't have"):
        split.change(lambda m: m.withColumn("entry", F.col("entry") + 1000))


def test_empty_bank_and_defaults(spark, tmp_path):
    bank = bank_of(spark)
    empty = SplitBank.create(bank.where("false"), f"{tmp_path}/none")
    assert empty.rows().count() == 0 and empty.change(lambda m: m) == 2
    plain = SplitBank.create(bank.select("tier", "label", "entry", "row", "vec"), f"{tmp_path}/plain", now=7)
    assert {(r.severity, r.registered_at, r.last_hit, r.hit_count, r.memory) for r in plain.meta().collect()} == {(2, 7, 7, 0, 0)}
