"""Regions, size filters and morphology over many small tiles, against plain loops over whole images."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.operators import masks as m
from patchlake.operators.star import components

SCHEMA = "image bigint, y int, x int, class int, confidence double"


def plain_parts(mask, diagonal):
    label, parts = np.zeros(mask.shape, int), []
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            if mask[y, x] and not label[y, x]:
                todo, own = [(y, x)], []
                label[y, x] = len(parts) + 1
                while todo:
                    a, b = todo.pop()
                    own.append((a, b))
                    for da in (-1, 0, 1):
                        for db in (-1, 0, 1):
                            c, d = a + da, b + db
                            if (diagonal or abs(da) + abs(db) == 1) and 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] == mask[y, x] and not label[c, d]:
                                label[c, d] = len(parts) + 1
                                todo.append((c, d))
                parts.append(own)
    return label, parts


def spiral(n):
    out, y, x, dy, dx = np.zeros((n, n), int), 0, 0, 0, 1
    for _ in range(n * n):
        out[y, x] = 1
        ahead = y + 2 * dy, x + 2 * dx
        if not (0 <= y + dy < n and 0 <= x + dx < n) or 0 <= ahead[0] < n and 0 <= ahead[1] < n and out[ahead]:
            dy, dx = dx, -dy
            if not (0 <= y + dy < n and 0 <= x + dx < n) or out[y + dy, x + dx]:
                break
        y, x = y + dy, x + dx
    return out


def images():
    rng = np.random.default_rng(2)
    return {1: rng.integers(0, 3, (37, 29)), 2: spiral(41), 3: np.ones((33, 17), int), 4: np.zeros((5, 5), int), 5: (rng.random((50, 23)) < 0.6).astype(int), 6: np.array([[3]])}


def rows_of(found):
    return [(i, y, x, int(mask[y, x]), (y * 7 + x) % 10 / 10) for i, mask in found.items() for y in range(mask.shape[0]) for x in range(mask.shape[1])]


@pytest.mark.parametrize("side", [4, 8, 512])
def test_regions(spark, side):
    want = []
    for i, mask in images().items():
        for own in plain_parts(mask, True)[1]:
            y, x = np.array(own).T
            want.append((i, int(mask[own[0]]), len(own), y.min(), x.min(), y.max(), x.max(), np.round(y.mean(), 1), np.round(x.mean(), 1), round(float(np.mean((y * 7 + x) % 10 / 10)), 6)))
    rows = rows_of(images())
    random.Random(1).shuffle(rows)
    t = spark.createDataFrame(rows + rows[:50] + [(None, 1, 1, 1, 0.5), (7, None, 1, 1, 0.5), (7, 1, 1, None, 0.5)], SCHEMA).repartition(3)
    got = m.regions(t, side).collect()
    assert sorted((r.image, r["class"], r.area, r.y0, r.x0, r.y1, r.x1, r.cy, r.cx, round(r.confidence, 6)) for r in got) == sorted(want)
    for i in images():
        own = sorted((r for r in got if r.image == i), key=lambda r: r.region)
        assert [r.region for r in own] == list(range(len(own))) and [r.area for r in own] == sorted((r.area for r in own), reverse=True)


@pytest.mark.parametrize("side", [4, 512])
def test_size_filter(spark, side):
    found = images()
    for least, most in ((3, 0), (2, 40), (1, 0)):
        want = {}
        for i, mask in found.items():
            label, parts = plain_parts(mask, False)
            for y in range(mask.shape[0]):
                for x in range(mask.shape[1]):
                    n = len(parts[label[y, x] - 1]) if label[y, x] else 0
                    want[i, y, x] = int(mask[y, x]) if n >= least and (most == 0 or n <= most) else 0
        t = spark.createDataFrame(rows_of(found) + [(8, None, 1, 5, 0.0)], SCHEMA).withColumn("px", F.lit(9))
        got = m.size_filter(t, least, most, side)
        assert got.columns == t.columns
        got = {(r.image, r.y, r.x): r["class"] for r in got.collect()}
        assert got.pop((8, None, 1)) == 5 and got == want


@pytest.mark.parametrize("kind", ["open", "close", "open_close"])
def test_morphology_over_tiles(spark, kind):
    t = spark.createDataFrame([r for r in rows_of(images()) if (r[1] * 5 + r[2]) % 11], SCHEMA)
    whole = {(r.image, r.y, r.x): r["class"] for r in m.morphology(t, kind, 3, 512).collect()}
    tiled = {(r.image, r.y, r.x): r["class"] for r in m.morphology(t, kind, 3, 4).collect()}
    assert whole == tiled and len(whole) == t.count() and len(set(whole.values())) > 1


def test_empty(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert m.regions(t).count() == m.size_filter(t, 2).count() == m.morphology(t, "open", 3).count() == 0


def test_components_of_structs(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    up = list(range(300))
    top = lambda x: x if up[x] == x else top(up[x])
    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    t = spark.createDataFrame(links, "x bigint, y bigint").select(F.struct(F.lit("i").alias("i"), "x").alias("a"), F.struct(F.lit("i").alias("i"), F.col("y").alias("x")).alias("b"))
    got = {r.id.x: r.component.x for r in components(t).collect()}
    assert got == {i: top(i) for i in range(300) if top(i) != i}
    assert components(t.where("false")).count() == 0
