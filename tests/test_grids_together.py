"""Many small images at a time: heat maps, merged grids, morphology, sizes."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from patchlake.operators import evaluation as e
from patchlake.operators import masks as m


def test_heat_maps_of_one_shape_are_made_together():
    rng = np.random.default_rng(1)
    n = 3000
    cells = [[(0, 0), (2, 3), (1, 1)] if i % 2 else [(3, 1)] for i in range(n)]
    scores = [rng.random(len(c)).tolist() for c in cells]
    b = pa.RecordBatch.from_pydict({"image": list(range(n)), "height": [11 if i % 2 else 14 for i in range(n)], "width": [15 if i % 2 else 9 for i in range(n)], "gy": [[y for y, _ in c] for c in cells], "gx": [[x for _, x in c] for c in cells], "score": scores})
    out = list(e.pixels_of(4, iter([b])))
    assert len(out) < 10
    got = {(i, y): s for o in out for i, y, s in zip(*(o.column(k).to_pylist() for k in range(3)), strict=True)}
    assert len(got) == sum(11 if i % 2 else 14 for i in range(n))
    for i in range(0, n, 97):
        grid = np.zeros((3, 4) if i % 2 else (4, 2))
        for (y, x), s in zip(cells[i], scores[i], strict=True):
            grid[y, x] = s
        for y in range(11 if i % 2 else 14):
            for x, s in enumerate(got[i, y]):
                v, u = (min(max((p + 0.5) / 4 - 0.5, 0), k - 1) for p, k in zip((y, x), grid.shape, strict=True))
                want = sum(grid[a, c] * max(0, 1 - abs(v - a)) * max(0, 1 - abs(u - c)) for a in range(grid.shape[0]) for c in range(grid.shape[1]))
                assert abs(s - want) < 1e-12


def test_grids_are_merged_with_one_shuffle(spark):
    cells = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 1, 3.0), (1, 1, 2, 5.0), (2, 0, 0, 1.0), (3, 2, 0, 7.0)], "image bigint, gy bigint, gx bigint, score double")
    out = e.grid_merge(cells, F.col("gy") + 1, F.col("gx") + 1)
    want = {(1, y, x): {(0, 1): 3.0, (1, 2): 5.0}.get((y, x), 4.0) for y in range(2) for x in range(3)} | {(2, 0, 0): 1.0} | {(3, y, 0): 7.0 for y in range(3)}
    assert {(r.image, r.gy, r.gx): r.score for r in out.collect()} == want
    assert out._jdf.queryExecution().sparkPlan().toString().count("Exchange") + out._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1].count("Exchange") <= 2


def tiles(n, own=True):
    """One tile for each of n images, of four pixels."""
    i = np.repeat(np.arange(n), 4)
    y, x = np.tile([0, 0, 2, 2], n), np.tile([0, 2, 0, 2], n)
    columns = {"image": i, "ty": i * 0, "tx": i * 0, "y": y, "x": x, "class": 1 + i % 2, "y0": i * 0, "x0": i * 0, "y1": i * 0 + 2, "x1": i * 0 + 2}
    out = pa.table({k: pa.array(v.astype(np.int64)) for k, v in columns.items()} | {"own": pa.array(np.ones(len(i), bool))})
    return out.append_column("kept", pa.StructArray.from_arrays([out.column("image").combine_chunks()], ["image"])).to_batches(10_000)


def test_tiles_of_one_shape_are_morphed_together(monkeypatch):
    calls, plain = [], m.spread
    monkeypatch.setattr(m, "spread", lambda *a: calls.append(1) or plain(*a))
    out = list(m.morphed_rows("close", 3, 512, 2, iter(tiles(3000))))
    assert sum(b.num_rows for b in out) == 12_000 and len(calls) <= 8
    assert {v for b in out for v in b.column("morphed").to_pylist()} == {1, 2}  # corners of a square that is closed


def test_a_task_labels_in_little_memory():
    batches = tiles(120_000)
    tracemalloc.start()
    n = sum(b.num_rows for b in m.labelled_rows(512, False, iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 480_000 and peak < 40e6
