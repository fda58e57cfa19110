"""Operators without SQL, and edge cases, against numpy and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.operators import assembly as a
from patchlake.operators import clusters as c
from patchlake.operators import evaluation as e
from patchlake.operators import lists
from patchlake.operators import masks as m
from patchlake.operators import memory as mem
from patchlake.operators import projection as p
from patchlake.operators.knn import label_nearest, nearest_mean
from patchlake.operators.ordered import merged_intervals, totals_before


def rows(spark, x, per_entry=5, tier="normal"):
    data = [(i // per_entry, i % per_entry, i, tier, f"g{i // 10}", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "entry bigint, row bigint, id bigint, tier string, grp string, vec array<double>")


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(60, 8))


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
@pytest.mark.parametrize("leave_out", ["none", "entry", "group"])
def test_nearest_mean(spark, x, block_bytes, leave_out):
    t = rows(spark, x)
    got = {r.id: r.score for r in nearest_mean(t, t, 5, leave_out, ["id"], block_bytes).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    i = np.arange(60)
    if leave_out == "entry":
        d[i[:, None] // 5 == i[None] // 5] = np.inf
    if leave_out == "group":
        d[i[:, None] // 10 == i[None] // 10] = np.inf
    want = np.sort(d, axis=1)[:, :5].mean(axis=1)
    assert np.allclose([got[k] for k in i], want, atol=1e-6)


def test_fewer_rows_than_k_and_none(spark, x):
    t = rows(spark, x[:12])
    few = {r.id: r.score for r in nearest_mean(t, t.where("entry = 0"), 10, "entry", ["id"]).collect()}
    assert few[0] is None and few[7] == pytest.approx(np.sqrt(((x[7] - x[:5]) ** 2).sum(-1)).mean())
    assert all(r.score is None for r in nearest_mean(t, t.where("false"), 5, "none", ["id"]).collect())
    assert nearest_mean(t.where("false"), t, 5).count() == 0


def test_label_nearest_in_blocks(spark, x):
    t = rows(spark, x).withColumn("label", F.concat(F.lit("l"), F.col("entry") % 3))
    one = sorted(map(tuple, label_nearest(t, t, "entry", keep=["id"]).collect()))
    many = sorted(map(tuple, label_nearest(t, t, "entry", keep=["id"], block_bytes=500).collect()))
    assert len(one) == 180 and [(r[0], r[1], r[3]) for r in one] == [(r[0], r[1], r[3]) for r in many]


def test_running_totals(spark):
    rng = random.Random(1)
    data = [(k, float(v), rng.randint(0, 9)) for k in range(3) for v in rng.sample(range(1000), 200)]
    t = spark.createDataFrame(data, "k int, v double, n int")
    for r in totals_before(t, "v", {"s": F.col("n")}, ("k",), buckets=16).collect():
        assert r.s == sum(n for k, v, n in data if k == r.k and v < r.v)
    for r in totals_before(t, "v", {"s": F.col("n")}, ("k",), kind="max", buckets=16).collect():
        below = [n for k, v, n in data if k == r.k and v < r.v]
        assert r.s == (max(below) if below else None)


def test_intervals(spark):
    def merged(spans, limit):
        t = spark.createDataFrame(spans, "start int, count int")
        return sorted((r[0], r[1]) for r in merged_intervals(t, limit=F.lit(limit)).collect())

    assert merged([(0, 5), (3, 4), (20, 5)], 100) == [(0, 7), (20, 5)]
    assert merged([(90, 50)], 100) == [(90, 10)] and merged([(5, 0), (-3, 2)], 100) == [] and merged([(0, 5), (5, 5)], 100) == [(0, 10)]


def test_auroc_edges(spark):
    def auroc(pos, neg):
        return e.auroc(spark.createDataFrame([(float(v), True) for v in pos] + [(float(v), False) for v in neg], "v double, positive boolean")).first()["auroc"]

    assert auroc([3, 4], [1, 2]) == 1.0 and auroc([1], [2]) == 0.0 and auroc([1, 1], [1, 1]) == 0.5 and np.isnan(auroc([1], [])) and auroc([1, 3, 3], [3, 0]) == pytest.approx((0.0 + 1 + 0.5 + 1 + 0.5 + 1) / 6)


def youden(ok, ng):
    cand, best, thr = sorted(ok + ng), -np.inf, None
    for lo, hi in zip(cand, cand[1:], strict=False):
        mid = (lo + hi) / 2
        j = sum(v > mid for v in ng) / len(ng) - sum(v > mid for v in ok) / len(ok)
        if j > best + 1e-12:
            best, thr = j, mid
    return thr


def test_youden(spark):
    rng = random.Random(2)
    for _ in range(6):
        ok, ng = [float(rng.randint(0, 12)) for _ in range(15)], [float(rng.randint(4, 16)) for _ in range(10)]
        t = spark.createDataFrame([(v, False) for v in ok] + [(v, True) for v in ng], "v double, positive boolean")
        assert e.youden(t).first()["threshold"] == youden(ok, ng)


def test_youden_of_all_events(spark, tmp_path):
    """Events with ids from 3,000 on count too; the query against brute force."""
    from patchlake.plans.registry import QUERIES

    rng = random.Random(3)
    events = [(i, float(rng.randint(0, 40)), "error" if i % 4 == 0 else "view") for i in range(40)]
    events += [(3000 + i, float(rng.randint(10, 60) + 20 * (i % 3 == 0)), "error" if i % 3 == 0 else "view") for i in range(60)]
    spark.createDataFrame(events, "event_id bigint, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    ok, ng = ([v for i, v, t in events if (t == "error") == bad] for bad in (False, True))
    assert QUERIES["o71_youden_all"](spark, str(tmp_path)).first()["threshold"] == round(youden(ok, ng), 6)
    assert QUERIES["o71_youden"](spark, str(tmp_path)).first()["threshold"] == round(youden(ok, ng), 6)


def test_best_alpha_ties_go_to_the_margin(spark):
    swept = spark.createDataFrame([(0, 0.9, -0.5), (5, 1.0, 0.1), (10, 1.0, 0.3), (15, 1.0, 0.3), (20, 0.95, 0.9)], "alpha int, auroc double, margin double")
    assert e.best_alpha(swept)[0] == 10


def water(sizes, ceiling):
    if ceiling <= 0 or sum(sizes) <= ceiling:
        return list(sizes)
    out, left, n = [0] * len(sizes), ceiling, len(sizes)
    for i in sorted(range(len(sizes)), key=lambda j: sizes[j]):
        out[i] = min(sizes[i], max(1, left // n))
        left, n = left - out[i], n - 1
    return out


@pytest.mark.parametrize("ceiling", [0, 3, 17, 100, 333, 10_000])
def test_budgets(spark, ceiling):
    rng = random.Random(ceiling)
    sizes = [rng.choice((1, 3, 7, 7, 20, 50, 51)) for _ in range(30)]
    t = spark.createDataFrame(list(enumerate(sizes)), "entry bigint, rows bigint")
    got = {r.entry: r.budget for r in a.budgets(t, ceiling).collect()}
    assert [got[i] for i in range(30)] == water(sizes, ceiling)


def test_coreset(spark, x):
    order = a.k_center(x, 10, step=1)
    d = lambda rows: np.sqrt(((x[:, None] - x[rows][None]) ** 2).sum(-1)).min(axis=1).max()
    assert len(set(order)) == 10 and a.k_center(x, 10, step=1)[:5] == a.k_center(x, 5, step=1)
    assert d(order) <= 2 * min(d(list(np.random.default_rng(s).choice(60, 10, replace=False))) for s in range(50))
    assert set(a.k_center(x, 5, forced=[1, 2, 3])) >= {1, 2, 3} and len(a.k_center(x, 2, forced=[1, 2, 3])) == 3 and a.k_center(x, 0) == []
    t = rows(spark, x, 20).withColumn("marked", F.col("row") == 4)
    kept = a.coreset(t, F.lit(6), F.col("marked")).collect()
    assert len(kept) == 18 and {(r.entry, r.row) for r in kept} >= {(i, 4) for i in range(3)}
    wide = np.random.default_rng(1).normal(size=(200, 300))
    low = a.projected(wide)
    ratio = np.linalg.norm(low[:50] - low[50:100], axis=1) / np.linalg.norm(wide[:50] - wide[50:100], axis=1)
    assert low.shape == (200, 128) and abs(ratio.mean() - 1) < 0.1


def test_assembly_and_migration(spark, x):
    feats = rows(spark, x, 10).select("entry", "row", "vec")
    images = spark.createDataFrame([(i, f"n{i}", 10, None) for i in range(6)], "entry bigint, name string, rows bigint, kept array<bigint>")
    given = spark.createDataFrame([(0, "normal", "", 2, []), (1, "critical", "Scratch", 1, [2, 3, 77]), (2, "critical", "Scratch", 9, []), (3, "other", "", 2, []), (4, "normal", "x", 2, [1])], "entry bigint, tier string, label string, severity int, marks array<bigint>")
    bank = a.assemble(images, given, feats, 100, 50).cache()
    found = {(r.entry, r.row): r for r in bank.collect()}
    assert {k[0] for k in found} == {0, 1, 2, 4} and len(found) == 40
    assert [found[1, i].severity for i in range(5)] == [1, 1, 3, 3, 1] and found[2, 0].severity == 3 and found[0, 0].label == found[4, 0].label == "" and found[1, 0].label.startswith("scratch-")
    assert a.assemble(images, given, feats, 8, 50).groupBy("tier").count().where("count > 8").isEmpty()
    back = {r.entry: r for r in a.base_severity(bank.where("tier <> 'normal'")).collect()}
    assert back[1].severity == 1 and back[1].marks == [2, 3] and back[2].severity == 3 and back[2].marks == []
    assert a.bank_diff(bank, a.assemble(images, given, feats, 100, 50)).isEmpty()
    hit = mem.hit(bank, bank.where("entry = 1 and row = 0").unionByName(bank.where("entry = 1 and row = 0")), 60)
    again = {(r.entry, r.row): r for r in a.assemble(images, given, feats, 100, 99, hit).collect()}
    assert again[1, 0].hit_count == 1 and again[1, 0].last_hit == 60 and again[1, 1].hit_count == 0
    one, two = (a.fingerprint(images, t).first()[0] for t in (given, given.where("entry <> 4")))
    assert len(one) == 32 and one != two and one == a.fingerprint(images.repartition(5), given.repartition(3)).first()[0]
    with pytest.raises(ValueError, match="without rows"):
        a.assemble(images, given, feats.where("entry <> 2"), 100, 50)


def test_cleared_and_protected(spark, x):
    with pytest.raises(ValueError, match="protected"):
        mem.clear(rows(spark, x), "normal")


def test_clusters(spark):
    rng = np.random.default_rng(7)
    blobs = np.concatenate([100 * k + rng.normal(size=(80, 8)) for k in range(3)])
    t = rows(spark, blobs)
    centers = c.build(t, 6, 10)
    bank = c.assign(t, centers).cache()
    assert bank.groupBy("cluster").count().agg(F.sum("count")).first()[0] == 240
    q = t.select("id", "entry", "vec")
    full = {r.id: r.score for r in nearest_mean(t, t, 5, "entry", ["id"]).collect()}
    every = {r.id: r.score for r in lists.searched_mean(q, lists.listed(bank, centers), 5, 6, "entry").collect()}
    narrow = {r.id: r.score for r in lists.searched_mean(q, lists.listed(bank, centers), 5, 1, "entry").collect()}
    assert all(abs(full[i] - every[i]) < 1e-5 and narrow[i] >= full[i] - 1e-5 for i in full)
    gone = {r.id: r.score for r in lists.searched_mean(q, lists.listed(bank.where("id >= 160"), centers), 5, 1).collect()}
    assert len(gone) == 240 and gone[0] > 100  # nothing in its clusters: all rows are searched
    assert c.n_clusters(100) == 16 and c.n_clusters(10**6) == 1024 and c.needs_rebuild(151, 100) and not c.needs_rebuild(150, 100)


def test_projection(spark):
    rng = np.random.default_rng(0)
    normal, odd = rng.normal(size=(300, 16)), rng.normal(size=(200, 16)) * 0.5
    odd[:, 0] += 5
    t, u = rows(spark, normal), rows(spark, odd, tier="critical")
    mean, axes, share = p.normal_axes(t)
    cov = np.cov(normal.T, bias=True)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert np.allclose(cov @ axes, axes * values[:2], atol=1e-8) and np.allclose(share, 100 * values[:2] / values.sum())
    both = p.projected(t.unionByName(u)).toPandas().groupby("tier")["x"].mean()
    assert both["critical"] > 3 and abs(both["normal"]) < 0.5
    assert p.projected(t.limit(1)).count() == 0
    sample = p.seeded_sample(t, 20, ("id",), t.where("id in (3, 4)"))
    assert sample.count() == 20 and sample.where("id in (3, 4)").count() == 2 and p.seeded_sample(t, 1, ("id",), t.where("id < 5")).count() == 5
    same = p.parity(t.select("id", "vec"), t.select("id", "vec")).first()
    assert same.passed and same.rel_max == 0


def test_morphology(spark):
    rng = np.random.default_rng(3)
    mask = rng.choice([0, 0, 1, 1, 2], size=(14, 17))
    t = spark.createDataFrame([(1, y, xx, int(mask[y, xx])) for y in range(14) for xx in range(17)], "image bigint, y int, x int, class int")

    def grown(own, largest):
        out = np.zeros_like(own)
        for y in range(14):
            for xx in range(17):
                near = own[max(0, y - 1) : y + 2, max(0, xx - 1) : xx + 2]
                out[y, xx] = near.any() if largest else near.all()
        return out

    for kind in ("open", "close", "open_close"):
        want = np.zeros_like(mask)
        for cls in (1, 2):
            own = mask == cls
            for step in kind.split("_"):
                own = grown(grown(own, step == "close"), step != "close")
            want[own] = cls
        got = {(r.y, r.x): r["class"] for r in m.morphology(t, kind, 2).collect()}
        assert all(got[y, xx] == want[y, xx] for y in range(14) for xx in range(17)), kind


def test_every_order_is_an_image(spark, tmp_path):
    """Orders that the folded queries put into one image stay apart; regions against brute force, morphology by its images only."""
    from patchlake.plans.registry import QUERIES

    rng = random.Random(5)
    lines = [(o * 300, rng.randint(1, 30), rng.randint(1, 30), rng.choice("ANR"), 0.05) for o in range(1, 41) for _ in range(7)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    images = {}
    for o, part, supp, flag, _ in lines:
        at, cls = (supp % 12, part % 15), "RAN".index(flag) + 4 * (supp % 29 == 0)
        images.setdefault(o, {})[at] = min(cls, images.get(o, {}).get(at, 9))
    want = []
    for o, own in images.items():
        left = {k for k, c in own.items() if c > 0}
        while left:
            todo = [min(left)]
            left.discard(todo[0])
            part = []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                near = {(b, a) for b, a in left if max(abs(b - y), abs(a - x)) <= 1 and own[b, a] == own[y, x]}
                left -= near
                todo += near
            want.append((o, own[part[0]], len(part), min(part)[0], min(a for _, a in part)))
    got = QUERIES["o82_regions_by_order"](spark, str(tmp_path)).collect()
    assert sorted((r.image, r["class"], r.area, r.y0, r.x0) for r in got) == sorted(want)
    assert QUERIES["o84_morphology_by_order"](spark, str(tmp_path)).select("image").distinct().count() == len(images) == 40
    assert QUERIES["o84_morphology"](spark, str(tmp_path)).select("image").distinct().count() == 1


def test_tiles_of_distances_are_bounded(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from patchlake.operators import knn

    rng = np.random.default_rng(3)
    bank, queries = rng.normal(size=(200, 8)), rng.normal(size=(60, 8))
    frame = spark.createDataFrame([("b", i, v.tolist()) for i, v in enumerate(bank)], "entry string, row int, vec array<double>")
    path, blocks = knn.write_blocks(frame, 6000)
    seen = []
    plain = knn.distances
    monkeypatch.setattr(knn, "TILE_BYTES", 4000)
    monkeypatch.setattr(knn, "distances", lambda q, b: seen.append(plain(q, b)) or seen[-1])
    got = pd.concat(knn.mean_rows(path, blocks, 5, "none", ["id"], iter([pd.DataFrame({"id": range(60), "vec": list(queries)})])))
    want = np.sort(np.linalg.norm(queries[:, None] - bank[None], axis=2), axis=1)[:, :5].mean(axis=1)
    assert blocks > 1 and max(d.nbytes for d in seen) <= 4000
    assert np.allclose(got["score"].astype(float), want)
