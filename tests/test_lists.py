"""Search by lists against the full scan, and an index that follows its bank."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchlake.operators import clusters as c
from patchlake.operators import lists
from patchlake.operators.knn import nearest_mean
from patchlake.sources.versions import version

SCHEMA = "id bigint, entry bigint, row int, grp string, vec array<double>"


def bank_of(spark, n=400, modes=16, d=8, seed=3, first=0):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(99).normal(0, 6, (modes, d))
    rows = [(first + i, (first + i) // 5, i % 5, f"g{(first + i) // 20}" if i % 40 else "", (middles[(first + i) // 5 % modes] + rng.normal(0, 1, d)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def scores(df):
    return {r.id: None if r.score is None else round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("leave_out", ["none", "entry", "group"])
def test_all_lists_give_the_full_scan(spark, tmp_path, leave_out, monkeypatch):
    bank = bank_of(spark)
    monkeypatch.setattr(lists, "FILE_ROWS", 7)
    lists.built(bank.drop("id"), str(tmp_path), 12, 3)
    monkeypatch.setattr(lists, "GROUP", 50)
    index = lists.opened(spark, str(tmp_path))
    assert sorted(map(str, index.rows().select("entry", "row", "vec").collect())) == sorted(map(str, bank.select("entry", "row", "vec").collect()))
    want = scores(nearest_mean(bank, bank, 5, leave_out, ["id"]))
    assert scores(lists.searched_mean(bank, index, 5, 12, leave_out, block_bytes=600)) == want


def test_few_lists_are_mostly_enough(spark, tmp_path):
    bank = bank_of(spark, 800)
    lists.built(bank.drop("id"), str(tmp_path), 40, 8)
    index = lists.opened(spark, str(tmp_path))
    exact = nearest_mean(bank, bank, 5, "entry", ["id"]).withColumnRenamed("score", "exact")
    found = lists.recall(lists.searched_mean(bank, index, 5, 8, "entry"), exact).first()
    assert found.queries == 800 and found.recall >= 0.9
    assert lists.probes_for(bank, index, 5, 0.9, "entry") <= 16
    assert lists.probes_for(bank.limit(0), index) == 8


def test_queries_without_rows_left_are_searched_in_full(spark, tmp_path):
    bank = bank_of(spark, 40, 8).withColumn("vec", F.transform("vec", lambda x: x + F.col("entry") * 100))  # an entry is alone in its list
    centers = bank.where("row = 0").select(F.col("entry").cast("int").alias("cluster"), F.col("vec").alias("center"))
    index = lists.listed(c.assign(bank.drop("id"), centers), centers)
    assert scores(lists.searched_mean(bank, index, 3, 1, "entry")) == pytest.approx(scores(nearest_mean(bank, bank, 3, "entry", ["id"])))
    assert set(scores(lists.searched_mean(bank, index, 100, 8, "none")).values()) != {None}


def test_an_index_follows_its_bank(spark, tmp_path):
    root, bank, more = str(tmp_path), bank_of(spark).drop("id"), bank_of(spark, 50, first=400, seed=8).drop("id")
    assert lists.refreshed(bank, root, 10, 3) == "built" and lists.refreshed(bank, root) == "kept"
    number = version(spark, root)["number"]
    assert lists.refreshed(bank.unionByName(more), root) == "extended" and lists.opened(spark, root).rows().count() == 450
    assert lists.opened(spark, root, number).rows().count() == 400  # the old one is still there
    assert lists.refreshed(bank.unionByName(more), root, 10, 3) == "kept"
    assert lists.refreshed(bank.where("entry <> 3"), root, 10, 3) == "built"  # gone
    assert lists.refreshed(bank.where("entry <> 3").withColumn("vec", F.when(F.col("entry") == 5, F.reverse("vec")).otherwise(F.col("vec"))), root, 10, 3) == "built"  # changed
    large = bank.unionByName(bank_of(spark, 400, first=400, seed=8).drop("id"))
    lists.built(bank, root, 10, 3)
    assert lists.refreshed(large, root, 10, 3) == "built"  # too much growth
    plain = lists.searched_mean(bank_of(spark), lists.opened(spark, root), 5, 10, "entry")
    assert scores(plain) == scores(nearest_mean(bank_of(spark), large, 5, "entry", ["id"]))


def test_more_centroids_than_are_sent(spark):
    bank = bank_of(spark, 200)
    centers = bank.where("row = 0").select(F.col("entry").cast("int").alias("cluster"), F.col("vec").alias("center"))
    sent = {(r.id, r.probe): r.cluster for r in c.probes(bank, centers, 3, ["id"]).collect()}
    assert {(r.id, r.probe): r.cluster for r in c.probes(bank, centers, 3, ["id"], most=10).collect()} == sent and len(sent) == 600


@pytest.mark.parametrize("leave_out", ["none", "entry", "group"])
def test_going_over_all_lists_finds_what_routing_finds(spark, tmp_path, leave_out, monkeypatch):
    bank = bank_of(spark)
    lists.built(bank.drop("id"), str(tmp_path), 12, 3)
    index = lists.opened(spark, str(tmp_path))
    monkeypatch.setattr(lists, "TOGETHER", 30)
    found = []
    for share in (0, 12):
        monkeypatch.setattr(lists, "SCAN_SHARE", share)
        found.append(scores(lists.searched_mean(bank, index, 5, 4, leave_out, block_bytes=600)))
    assert found[0] == found[1] and len(found[0]) == 400


def test_many_probes_are_given_out_in_bounded_batches():
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"id": range(200), "vec": list(rng.normal(size=(200, 4)))})
    centers = rng.normal(size=(500, 4)).round(0)  # many equals
    got = list(c.ranked_centers(centers, np.arange(500, dtype=np.int32), 300, ["id", "vec"], iter([rows])))
    assert max(map(len, got)) <= 8192 and sum(map(len, got)) == 200 * 300
    d = ((np.stack(rows["vec"])[:, None] - centers[None]) ** 2).sum(axis=2).round(9)
    both = pd.concat(got)
    assert (np.lexsort((np.broadcast_to(np.arange(500), d.shape), d), axis=1)[:, :300] == both["cluster"].to_numpy().reshape(200, 300)).all()
