"""The built index finds what a full scan finds, and the assembly's queries without SQL against plain models."""

import numpy as np
import pytest
from patchlake.plans import assembled
from patchlake.plans.binding import bank_rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 3, (12, 8))
    rows = [(i, (middles[i % 12] + rng.normal(0, 1, 8)).astype(np.float32).tolist()) for i in range(300)]
    path = tmp_path_factory.mktemp("bank")
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_recall_of_the_query(spark, sf_dir):
    found = assembled.o116_index_recall(spark, sf_dir).first()
    assert found.queries == 300 and found.recall >= 0.9 and found.probed <= found.clusters


def test_axes(spark, sf_dir):
    rows = bank_rows(spark, sf_dir).select("vec_id", "tier", "vec").toPandas()
    x = np.array(rows["vec"].tolist())
    own = x[(rows["tier"] == "normal").to_numpy()]
    _, _, axes = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)
    want = np.abs((x - own.mean(axis=0)) @ axes[:2].T)
    got = assembled.o121_normal_axes(spark, sf_dir).toPandas().set_index("vec_id").loc[rows["vec_id"], ["x", "y"]].to_numpy()
    assert np.allclose(np.abs(got), want, atol=1e-8)


def test_sample_holds_the_forced_rows(spark, sf_dir):
    got = {r.vec_id for r in assembled.o95_seeded_sample(spark, sf_dir).collect()}
    assert len(got) == 200 and {i for i in range(300) if i % 3 == 2 and i % 10 == 0} <= got
