"""The exact search by regions: the full scan's answers, from few of the pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchlake.operators import lists
from patchlake.operators.knn import nearest_mean
from patchlake.plans import assembled

from .test_lists import SCHEMA, bank_of


def scores(df):
    return {r.id: None if r.score is None else round(r.score, 8) for r in df.collect()}


@pytest.mark.parametrize("leave_out", ["none", "entry", "group"])
def test_the_answers_are_those_of_the_full_scan(spark, leave_out, monkeypatch):
    monkeypatch.setattr(lists, "TOGETHER", 30)
    monkeypatch.setattr(lists, "FILE_ROWS", 7)
    plain = bank_of(spark, 300)
    wide = bank_of(spark, 60, 5, first=300, seed=4).withColumn("vec", F.transform("vec", lambda x: x * 1e-7))  # near each other
    far = bank_of(spark, 20, 5, first=360, seed=5).withColumn("vec", F.transform("vec", lambda x: x * 1e9))
    copies = plain.where("id < 40").withColumns({"id": F.col("id") + 1000, "entry": F.col("entry") + 1000})
    odd = spark.createDataFrame([(2000, 2000, 0, "", [float("nan")] * 8), (2001, 2001, 0, "", [float("inf")] + [0.0] * 7), (2002, 2002, 0, None, [1e200] * 8)], SCHEMA)
    bank = plain.unionByName(wide).unionByName(far).unionByName(copies).unionByName(odd)
    got, want = scores(lists.exact_mean(bank, bank, 5, leave_out, 600)), scores(nearest_mean(bank, bank, 5, leave_out, ["id"]))
    assert len(got) == 423 and {i: s is None for i, s in got.items()} == {i: s is None for i, s in want.items()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-7, abs=1e-8) for i in got if got[i] is not None)


def test_few_or_no_rows(spark):
    bank = bank_of(spark, 12)
    assert scores(lists.exact_mean(bank, bank, 50, "entry")) == pytest.approx(scores(nearest_mean(bank, bank, 50, "entry", ["id"])))
    assert scores(lists.exact_mean(bank, bank.where("entry = 0"), 5, "entry")) == pytest.approx(scores(nearest_mean(bank, bank.where("entry = 0"), 5, "entry", ["id"])))
    assert set(scores(lists.exact_mean(bank, bank.limit(0))).values()) == {None} and scores(lists.exact_mean(bank.limit(0), bank)) == {}


def test_rows_that_cluster_are_compared_with_few_others(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 40, (16, 8))
    x = middles[np.arange(800) % 16] + rng.normal(0, 1, (800, 8))
    bank = spark.createDataFrame([(i, i, 0, v.tolist()) for i, v in enumerate(x)], "id bigint, entry bigint, row int, vec array<double>")
    centers = lists.far_apart(x, 16)
    assert len({int(((middles - c) ** 2).sum(axis=1).argmin()) for c in centers}) == 16  # one in each cluster
    own = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    away = np.sqrt(((x - centers[own]) ** 2).sum(axis=1))
    put = bank.join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "id bigint, cluster int"), "id")
    lists.write_lists(put.drop("id"), f"{tmp_path}/lists")
    low, high = (np.array([f(away[own == c]) for c in range(16)]) for f in (np.min, np.max))
    order, pairs, plain = np.argsort(own, kind="stable"), [], lists.nearer
    monkeypatch.setattr(lists, "nearer", lambda near, q, square, q1, block, keys, rows, columns: pairs.append((rows.stop - rows.start) * len(block["vec"][columns])) or plain(near, q, square, q1, block, keys, rows, columns))
    asked = pa.RecordBatch.from_pydict({"cluster": own[order].astype(np.int32), "id": order, "entry": order, "grp": pa.nulls(800, pa.string()), "vec": list(x[order])})
    got = {r["id"]: r["score"] for b in lists.exact_rows(f"file://{tmp_path}", [f"{tmp_path}/lists"], centers, low, high, 5, "entry", 1 << 20, iter([asked])) for r in b.to_pylist()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5].mean(axis=1)
    assert np.allclose([got[i] for i in range(800)], want) and sum(pairs) < 800 * 800 / 8


def test_the_query_asks_no_full_scan(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 16).astype(np.float32).tolist()) for i in range(300)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(assembled, "nearest_mean", None)
    found = assembled.o116_mixture_recall(spark, str(tmp_path)).first()
    assert (found.queries, found.again, found.later) == (3000, "kept", "extended")
