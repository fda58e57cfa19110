"""What a task of a search holds, and how its queries are dealt out."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from patchlake.operators import knn

SCHEMA = "id bigint, entry bigint, row int, grp string, label string, vec array<double>"


@pytest.fixture(scope="module")
def bank(spark):
    x = np.random.default_rng(5).normal(size=(30_000, 16))
    rows = pd.DataFrame({"id": range(30_000), "entry": np.arange(30_000) // 10, "row": np.arange(30_000) % 10, "grp": "g", "label": [f"l{i % 3}" for i in range(30_000)], "vec": x.tolist()})
    return spark.createDataFrame(rows, SCHEMA).withColumn("row", knn.F.col("row").cast("int")), rows


@pytest.mark.parametrize("by_label", [False, True])
def test_a_task_holds_little(bank, by_label):
    df, rows = bank
    path, blocks = knn.write_blocks(df)
    tracemalloc.start()
    batch = iter([rows.iloc[:1500]])
    out = list(knn.label_rows(path, blocks, "entry", ["id"], batch) if by_label else knn.mean_rows(path, blocks, 5, "entry", ["id"], batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, out)) == 1500 * (3 if by_label else 1) and peak < 70e6


def test_queries_of_one_partition_are_dealt_out(bank):
    df = bank[0].limit(200).coalesce(1)
    assert knn.nearest_mean(df, df, keep=["id"]).rdd.getNumPartitions() > 4
    assert knn.label_nearest(df, df, keep=["row"]).rdd.getNumPartitions() > 4


def peak_of(run) -> float:
    tracemalloc.start()
    list(run())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


@pytest.mark.parametrize("by_label", [False, True])
def test_a_tile_is_small_whatever_the_block(bank, by_label):
    df, rows = bank
    path, blocks = knn.write_blocks(df)
    some = rows.iloc[:1500]
    scan = lambda: knn.label_rows(path, blocks, "group", ["id"], iter([some])) if by_label else knn.mean_rows(path, blocks, 5, "group", ["id"], iter([some]))
    assert blocks == 1 and peak_of(scan) < 30e6


def test_centers_are_compared_in_small_tiles():
    from patchlake.operators.clusters import nearest_centers

    x = np.random.default_rng(3).normal(size=(24_000, 8))
    assert peak_of(lambda: nearest_centers(x[:2000], x, np.arange(len(x)), 1)) < 20e6


@pytest.mark.parametrize("leave_out", ["none", "entry", "group"])
def test_tiles_and_blocks_leave_the_same_rows_out(spark, monkeypatch, leave_out):
    monkeypatch.setattr(knn, "WIDE", 7)
    monkeypatch.setattr(knn, "TILE_BYTES", 8 * 7 * 3)
    x = np.random.default_rng(8).normal(size=(300, 4))
    x[200:] = x[:100]  # equal rows of other entries
    rows = pd.DataFrame({"id": range(300), "entry": np.arange(300) * 7 % 40, "row": range(300), "grp": [["", "a", "b", "c"][i % 4] for i in range(300)], "label": [f"l{i % 5}" for i in range(300)], "vec": x.tolist()})
    path, blocks = knn.write_blocks(spark.createDataFrame(rows, SCHEMA.replace("row int", "row bigint")), 10_000)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    entry, grp = rows["entry"].to_numpy(), rows["grp"].to_numpy()
    out = np.zeros((300, 300), bool) if leave_out == "none" else entry[:, None] == entry[None]
    if leave_out == "group":
        out |= (grp[:, None] == grp[None]) & (grp != "")[:, None]
    d[out] = np.inf
    got = pd.concat(knn.mean_rows(path, blocks, 5, leave_out, ["id"], iter([rows])))
    assert blocks > 1 and np.allclose(got["score"].to_numpy(float), np.sort(d, axis=1)[:, :5].mean(axis=1), atol=1e-9)
    near = pd.concat(knn.label_rows(path, blocks, leave_out, ["id"], iter([rows]))).sort_values(["label", "id"])
    for label, own in near.groupby("label"):
        at = np.flatnonzero(rows["label"] == label)
        least = d[:, at].min(axis=1)
        assert np.array_equal(own["id"], np.flatnonzero(np.isfinite(least))) and np.allclose(own["distance"], least[own["id"]], atol=1e-6)


STREAMED = """
import sys, time
import pyarrow as pa, pyarrow.fs as fs
from patchlake.operators.lists import blocks
n = 0
for b in blocks(fs.LocalFileSystem(), [sys.argv[1]], 5, 1 << 20):
    n += len(b)
    time.sleep(0.005)
print(n, pa.default_memory_pool().max_memory())
"""


def test_a_large_list_is_streamed(tmp_path):
    import subprocess
    import sys

    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "cluster=5").mkdir()
    x = np.random.default_rng(9).normal(size=60_000 * 32)
    for i in range(4):  # 15 MB each
        pq.write_table(pa.table({"entry": np.arange(60_000), "vec": pa.ListArray.from_arrays(np.arange(60_001, dtype=np.int32) * 32, x)}), tmp_path / "cluster=5" / f"{i}.parquet")
    said = subprocess.run([sys.executable, "-c", STREAMED, str(tmp_path)], capture_output=True, text=True, check=True).stdout.split()
    assert said[0] == "240000" and int(said[1]) < 90e6
