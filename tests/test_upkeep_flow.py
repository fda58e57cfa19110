"""Digests, evaluations kept up to date, capped images, projections, colours and profiles against plain models."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.functions import colors
from patchlake.functions.digest import digest, digest_sql, merged, sums_of
from patchlake.operators import assembly as a
from patchlake.operators import evaluations as ev
from patchlake.operators import projection as p
from patchlake.operators.knn import nearest_mean
from patchlake.sources import profile as pr
from patchlake.sources.versions import version

BANK = "tier string, label string, entry bigint, row bigint, vec array<double>"


def bank_of(spark, entries=12, rows=6, d=5, seed=1):
    rng = np.random.default_rng(seed)
    data = [(t, "" if t == "normal" else f"d{e % 2}", e, r, (rng.normal(0, 1, d) + (3 if t != "normal" else 0)).tolist()) for e in range(entries) for t in [("normal", "normal", "critical", "negative")[e % 4]] for r in range(rows)]
    return spark.createDataFrame(data, BANK)


# ---- digests


def test_digests_do_not_depend_on_order_or_partitioning(spark):
    lines = [f"line {i % 37}" for i in range(200)] + [None]
    rng, found = random.Random(1), set()
    for parts in (1, 3, 16):
        rng.shuffle(lines)
        t = spark.createDataFrame([(x,) for x in lines], "x string").repartition(parts)
        found.add(sums_of(t, F.col("x")).select(digest()).first()[0])
        halves = sums_of(t.withColumn("h", F.pmod(F.hash("x"), F.lit(5))), F.col("x"), ("h",))
        found.add(merged(halves).select(digest()).first()[0])
    words = [sum(int(hashlib.sha256(x.encode()).hexdigest()[16 * i : 16 * i + 16], 16) for x in lines if x) for i in range(4)]
    assert found == {hashlib.sha256(",".join(map(str, [200, *words])).encode()).hexdigest()}
    t = spark.createDataFrame([(x,) for x in lines[:-1]], "x string")
    assert sums_of(t, F.col("x")).select(digest()).first()[0] not in found
    import duckdb

    db = duckdb.connect()
    db.execute("create table t as select unnest(?) as x", [lines])
    assert {db.execute(f"select {digest_sql('x')} from t").fetchall()[0][0]} == found
    none = sums_of(spark.createDataFrame([], "x string"), F.col("x")).select(digest()).first()[0]
    assert none == hashlib.sha256(b"0,0,0,0,0").hexdigest() == db.execute(f"select {digest_sql('x')} from t where false").fetchall()[0][0]


def test_bank_digests(spark):
    bank = bank_of(spark).withColumn("severity", F.lit(2))
    both = lambda b, s="": tuple(a.bank_digests(b, s).first())
    e, c = both(bank)
    assert both(bank.repartition(7)) == (e, c)
    marked = bank.withColumn("severity", F.when((F.col("entry") == 2) & (F.col("row") == 1), 3).otherwise(2))
    assert both(marked)[0] == e and both(marked)[1] != c  # scores don't change with marks
    assert both(bank.where("entry <> 3"))[0] == e and both(bank.where("entry <> 3"))[1] != c
    assert both(bank.where("entry <> 0"))[0] != e and both(bank, "int8")[0] != e


# ---- evaluations


def test_only_what_changed_is_scored(spark, tmp_path):
    root, bank = str(tmp_path), bank_of(spark)
    assert ev.kept(spark, root) is None and ev.brought_up(bank, root) == {"kept": 0, "scored": 12, "purged": 0}
    assert ev.brought_up(bank.repartition(5), root) == {"kept": 12, "scored": 0, "purged": 0} and version(spark, root)["number"] == 1
    changed = bank.where("entry <> 3").withColumn("vec", F.when(F.col("entry") == 2, F.transform("vec", lambda x: x * 2)).otherwise(F.col("vec")))
    changed = changed.unionByName(spark.createDataFrame([("critical", "d9", 50, 0, [1.0] * 5)], BANK))
    assert ev.brought_up(changed, root) == {"kept": 10, "scored": 2, "purged": 2}  # one purged as it went, one as it changed
    scores = nearest_mean(changed, changed.where("tier = 'normal'"), 5, "entry", ["entry", "row"]).groupBy("entry").agg(F.max("score").alias("m")).collect()
    got = {r.entry: (r.score_max, r.since) for r in ev.kept(spark, root).collect()}
    assert {e: m for e, (m, _) in got.items()} == pytest.approx({r.entry: r.m for r in scores})
    assert {e for e, (_, since) in got.items() if since == 2} == {2, 50}
    assert ev.brought_up(changed.where("entry <> 0"), root)["kept"] == 0  # a normal image went: all scores may change
    assert ev.brought_up(changed.where("entry <> 0"), root, settings="int8")["kept"] == 0
    assert ev.brought_up(bank.where("false"), root) == {"kept": 0, "scored": 0, "purged": 11}


def test_deleting_images(spark, tmp_path):
    bank = bank_of(spark)
    ev.brought_up(bank, str(tmp_path))
    held = ev.kept(spark, str(tmp_path))
    ask = lambda *e: spark.createDataFrame([(x,) for x in e], "entry bigint")
    rows, left = ev.without_images(bank, held, ask(2, 3, 3, 99))
    assert rows.count() == 60 and {r.entry for r in left.collect()} == set(range(12)) - {2, 3}
    rows, left = ev.without_images(bank, held, ask(0))
    assert rows.count() == 66 and left.count() == 0


# ---- images with a cap


def test_caps_and_marks(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([("critical", "d", e, r, rng.normal(size=4).tolist(), 3 if r % 9 == e else 2) for e in range(3) for r in range(20 + e)], BANK + ", severity int")
    got = {}
    for r in a.capped(rows, 8, marked=F.col("severity") == 3).collect():
        got.setdefault(r.entry, []).append(r)
    plain = {(r.entry, r.row): r for r in rows.collect()}
    for e, own in got.items():
        own.sort(key=lambda r: r.row)
        marks = [r for r in range(20 + e) if r % 9 == e]
        assert [r.row for r in own] == list(range(8)) and [r.place for r in own][: len(marks)] == marks
        assert all(plain[e, r.place].vec == r.vec and plain[e, r.place].severity == r.severity and r.reduced for r in own)
    many = a.capped(rows, 2, marked=F.col("severity") == 3).groupBy("entry").count().collect()
    assert {r.entry: r["count"] for r in many} == {0: 3, 1: 3, 2: 3}  # marks beyond the cap stay
    assert a.capped(rows, 21, marked=F.col("severity") == 3).where("reduced").select("entry").distinct().count() == 1
    again = a.capped(a.capped(rows, 8), 4)
    assert {r.place for r in again.where("entry = 1").collect()} <= {r.place for r in a.capped(rows, 8).where("entry = 1").collect()}


def test_a_choice_that_starts_from_held_rows(spark):
    """Farthest points of a line, away from what is held."""
    held = spark.createDataFrame([("normal", "", 0, i, [float(i), 0.0]) for i in range(50)], BANK)
    new = spark.createDataFrame([("critical", "d", 1, i, [float(i), 0.0]) for i in range(100)], BANK)
    chosen = [r.place for r in a.capped(new, 3, held).orderBy("row").collect()]
    assert chosen[0] == 99 and all(c >= 50 for c in chosen)
    x = np.arange(100)[:, None].astype(float)
    assert a.k_center(x, 2, near=np.minimum.reduce([(x[:, 0] - i) ** 2 for i in range(50)]), step=1) == [99, 74]
    out = a.appended(held.withColumns({c: F.lit(1) for c in ("severity", "registered_at", "last_hit", "hit_count", "memory")}), new, 5, 3, True)
    assert out.count() == 53 and set(out.where("entry = 1").select("row").toPandas()["row"]) == {0, 1, 2}
    index = a.image_index(a.capped(new, 3, held)).first()
    assert sorted(index.kept) == sorted(chosen) and index["count"] == 3 and a.image_index(a.capped(new, 200)).first().kept is None


def test_reducing_needs_an_index_that_tiles(spark):
    bank = bank_of(spark).withColumns({"severity": F.when(F.col("row") == 4, 3).otherwise(2)})
    index = a.row_starts(bank.where("tier <> 'normal'"))
    out = a.reduced_bank(bank, index, 3)
    assert {r.tier: r["count"] for r in out.groupBy("tier").count().collect()} == {"normal": 36, "critical": 9, "negative": 9}
    assert out.where("tier <> 'normal' and row = 0 and place <> 4").count() == 0
    for wrong in (index.withColumn("start", F.col("start") + 1), index.withColumn("count", F.col("count") + 1), index.where("start > 0"), index.unionByName(index)):
        with pytest.raises(ValueError, match="tile"):
            a.reduced_bank(bank, wrong, 3)


# ---- projections


def test_points_of_a_bank(spark):
    bank = bank_of(spark, 16, 8)
    points, info = p.projection(bank, with_scores=True, per_tier=20)
    assert info["mode"] == "anomaly" and info["total"] == {"normal": 64, "critical": 32, "negative": 32} and info["sampled"] == {"normal": 20, "critical": 20, "negative": 20}
    want = {(r.entry, r.row): r.score for r in nearest_mean(bank, bank.where("tier = 'normal'"), 5, "entry", ["entry", "row"]).collect()}
    got = points.collect()
    assert len(got) == 60 and all(r.score == pytest.approx(want[r.entry, r.row]) for r in got)
    assert p.projection(bank, mode="normal")[1]["mode"] == "normal" and p.projection(bank.where("tier = 'normal'"))[1]["mode"] == "normal"
    assert p.projection(bank.where("tier <> 'normal'"))[1]["mode"] == "empty" and p.projection(bank.where("false"))[0].count() == 0


def test_images_and_guaranteed_rows(spark, tmp_path):
    bank = bank_of(spark, 16, 8)
    ev.brought_up(bank.where("entry <> 3"), str(tmp_path))
    held = ev.kept(spark, str(tmp_path))
    points, info = p.projection(bank, held, granularity="image", guaranteed=3)
    assert info["sampled"] == {"normal": 8, "critical": 4, "negative": 4} and points.count() == 16
    tops = {r.entry: [(t.score, t.row) for t in r.top[:3]] for r in held.collect()}
    rows = {}
    for r in bank.collect():
        rows.setdefault(r.entry, {})[r.row] = np.array(r.vec)
    vectors = {r.entry: r for r in p.image_vectors(bank, held, 3).collect()}
    for e, own in rows.items():
        want = np.mean([own[r] for _, r in tops[e]], axis=0) if e in tops else np.mean(list(own.values()), axis=0)
        assert np.allclose(vectors[e].vec, want) and vectors[e].score == (pytest.approx(np.mean([s for s, _ in tops[e]])) if e in tops else None)
    points, info = p.projection(bank, held, per_tier=10, guaranteed=2)
    shown = {(r.entry, r.row) for r in points.collect()}
    assert info["guaranteed"] == 30 and all((e, r) in shown for e, t in tops.items() for _, r in t[:2]) and info["sampled"]["normal"] == 16


@pytest.mark.parametrize("mode", ["normal", "anomaly"])
def test_axes_without_an_images_own_rows(spark, mode):
    bank = bank_of(spark, 12, 6)
    got = {(r.entry, r.row): (r.x, r.y) for r in p.projection(bank, mode=mode, leave_own=True)[0].collect()}
    for e in (0, 2, 3):
        rest = bank.where(f"entry <> {e}")
        _, mean, axes, _ = p.axes_for(rest, mode)
        for r in bank.where(f"entry = {e}").collect():
            assert np.allclose(np.abs(got[e, r.row]), np.abs((np.array(r.vec) - mean) @ axes), atol=1e-8)


# ---- colours


def test_overlays(spark):
    rng = np.random.default_rng(2)
    rows = [(i, k, float(rng.gamma(2)), int(rng.integers(256)), int(rng.integers(256)), int(rng.integers(256))) for i in range(4) for k in range(50)] + [(4, k, 0.0, 10, 20, 30) for k in range(5)]
    t = spark.createDataFrame(rows, "image int, k int, heat double, r int, g int, b int")
    anchors = spark.createDataFrame([(1, 0.5, 2.0), (2, 3.0, 1.0)], "image int, low double, high double")
    got = {(r.image, r.k): (r.r, r.g, r.b) for r in colors.overlays(t, anchors).collect()}
    for i in range(5):
        own = np.array([r[2] for r in rows if r[0] == i])
        lo, hi = np.percentile(own, 5), np.percentile(own, 99) or 1.0
        for _, k, h, *image in (r for r in rows if r[0] == i):
            if i == 1:
                s = np.clip((h - 2.0) / 1.5, -1, 1)
                color = np.array((235, 235, 235)) * (1 - abs(s)) + (np.array((0, 114, 178)) * -s if s < 0 else np.array((213, 94, 0)) * s)
                want = np.floor(np.clip(np.array(image) * 0.55 + color * 0.45 + 1e-9, 0, 255))
            else:
                x = np.floor(np.clip((h - lo) / max(hi - lo, 1e-6), 0, 1) * 255) / 255
                color = np.floor(np.clip(1.5 - np.abs(4 * x - np.array((3, 2, 1))), 0, 1) * 255 + 0.5)
                want = np.rint(np.array(image) * 0.55 + color * 0.45)
            assert np.abs(np.array(got[i, k]) - want).max() <= 1, (i, k)
    ends = spark.range(1).select(*[F.struct(*colors.turbo(F.lit(x)).values()).alias(n) for n, x in (("a", 0.1), ("m", 0.5), ("z", 1.0))]).first()
    assert ends.a[2] > ends.a[0] and ends.m[1] > 200 and ends.z[0] > 100 > ends.z[2]
    kinds = spark.createDataFrame([("tp",), ("ignored",), ("other",), (None,)], "k string").select(colors.error_colors(F.col("k")).alias("c")).collect()
    assert [r.c and tuple(r.c) for r in kinds] == [(0, 200, 0, 200), (0, 0, 0, 0), None, None]


# ---- profiles


def png(w, h):
    chunk = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + chunk + struct.pack(">I", zlib.crc32(b"IHDR" + chunk))


def test_heads_of_images():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\x03"
    assert pr.image_size(png(3, 5)) == (5, 3) and pr.image_size(jpeg) == (7, 9)
    assert pr.image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 4, -6)) == (6, 4) and pr.image_size(b"GIF89a" + struct.pack("<HH", 8, 2)) == (2, 8)
    assert pr.image_size(b"") is None and pr.image_size(b"\xff\xd8\xff") is None and pr.image_size(b"text") is None


def test_profile_is_kept_until_files_change(spark, tmp_path):
    for d in ("images/a", "images/b", "masks"):
        (tmp_path / d).mkdir(parents=True)
    sizes = {f"p{i}": (i + 1, i + 2) for i in range(30)}
    for i, (n, (w, h)) in enumerate(sizes.items()):
        (tmp_path / "images" / "ab"[i % 2] / f"{n}.png").write_bytes(png(w, h) + b"x" * i)
    (tmp_path / "masks" / "p0.png").write_bytes(b"12345")
    (tmp_path / "train.txt").write_text("\n".join([*sizes, "", "gone"]) + "\n")
    (tmp_path / "val.txt").write_text("v1\r\nv2\n")
    ask = lambda n: pr.profile(spark, f"{tmp_path}/images", f"{tmp_path}/masks", f"{tmp_path}/train.txt", f"{tmp_path}/val.txt", f"{tmp_path}/kept", n)
    ids = [*sizes, "gone"]
    picked = [ids[int(i * len(ids) / 7)] for i in range(7)]
    found = ask(7)
    pixels = [sizes[n][0] * sizes[n][1] for n in picked if n in sizes]
    assert (found["num_train"], found["num_val"], found["sample_size"]) == (31, 2, 7) and found["mask_bytes_max"] == 5
    assert (found["pixels_mean"], found["pixels_max"]) == (int(np.mean(pixels)), max(pixels)) and found["decoded_bytes_total"] == int(np.mean(pixels)) * 3 * 31
    assert found["read"] == len(pixels) and found["changed"] == 3
    assert ask(7) == found | {"read": 0, "changed": 0}
    target = next(tmp_path.glob(f"images/*/{picked[2]}.png"))
    target.write_bytes(png(1000, 1000))
    again = ask(7)
    assert again["read"] == 1 and again["changed"] == 1 and again["pixels_max"] == 10**6
    assert ask(100)["sample_size"] == 31
    empty = pr.profile(spark, f"{tmp_path}/images", f"{tmp_path}/masks", f"{tmp_path}/none.txt", f"{tmp_path}/val.txt", f"{tmp_path}/kept2")
    assert all(empty[f] == 0 for f in pr.FIELDS if f != "num_val")


# ---- scoring in one go


def test_scored_images(spark):
    from patchlake.operators.scorer import label_distances, scored_images

    bank = bank_of(spark, 12, 6).withColumn("id", F.col("entry") * 100 + F.col("row"))
    plain = [(r.tier, r.label, r.entry, r.row, np.array(r.vec), r.id) for r in bank.collect()]
    rows, images, won = scored_images(bank, bank, 3, 20.0, 5.0, "entry", top=2)
    got = {(r.entry, r.row): r for r in rows.collect()}
    for _, _, e, i, v, _ in plain:
        d = {t: sorted(float(np.linalg.norm(v - x)) for tier, _, o, _, x, _ in plain if tier == t and o != e) for t in ("normal", "critical", "negative")}
        r = got[e, i]
        assert (r.raw, r.critical, r.negative) == pytest.approx((np.mean(d["normal"][:3]), d["critical"][0], d["negative"][0]))
        assert r.score == pytest.approx(np.mean(d["normal"][:3]) + 20 / (1 + d["critical"][0]) - 5 / (1 + d["negative"][0]))
    for r in images.collect():
        own = sorted((g.score for (e, _), g in got.items() if e == r.entry), reverse=True)
        assert r.patches == 6 and r.score_max == pytest.approx(own[0]) and r.topk == pytest.approx(np.mean(own[:2]))
    near = label_distances(bank, bank, "entry").collect()
    for r in won.collect():
        best = min((n.distance, n.row) for n in near if (n.entry, n.tier, n.label) == (r.entry, r.tier, r.label))
        assert r.distance == best[0] and r.attribution == pytest.approx((20 if r.tier == "critical" else 5) / (1 + r.distance))
    alone, images, won = scored_images(bank, bank.where("tier = 'normal'"), 3, 20.0, 5.0)
    assert alone.where("score <> raw or critical is not null").count() == 0 and won.count() == 0 and images.count() == 12


def test_drift_gate(spark):
    t = bank_of(spark).withColumn("id", F.col("entry") * 100 + F.col("row"))
    bank, own = t.where("tier = 'normal'"), t.where("tier <> 'normal'").select("id", "vec")
    still = p.scored_parity(own, own, bank).first()
    assert still.passed and still.drift_max == 0
    far = p.scored_parity(own, own.withColumn("vec", F.transform("vec", lambda x: x * 1.002)), bank).first()
    assert far.rel_max == pytest.approx(0.002) and far.drift_mean > 0.05 and not far.passed
