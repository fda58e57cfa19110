"""Files, banks with a pointer, packages, and streams."""

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from patchlake.sources import files
from patchlake.streaming import inspection as st


def test_images_and_archives(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "mask").mkdir()
    for name in ("a.png", "b.JPG", "c.txt"):
        (tmp_path / "img" / name).write_bytes(b"x")
    (tmp_path / "mask" / "a.npy").write_bytes(b"y")
    pairs = {r.stem: r.mask for r in files.image_mask_pairs(spark, f"{tmp_path}/img", f"{tmp_path}/mask").collect()}
    assert set(pairs) == {"a", "b"} and pairs["a"].endswith("a.npy") and pairs["b"] is None
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("x/y/1.png", "__MACOSX/2.png", ".3.png", "../4.png", "d/", "5.txt", "6.tif"):
            z.writestr(name, name)
    assert sorted(r.name for r in files.zipped_images(spark, str(tmp_path)).collect()) == ["1.png", "6.tif"]
    good, bad = files.decoded(files.zipped_images(spark, str(tmp_path)), lambda b: (3, 4) if b"png" in b else None)
    assert [tuple(r) for r in good.collect()] == [("1.png", 3, 4)] and [r.name for r in bad.collect()] == ["6.tif"]


def test_saved_banks(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(5, 4)).astype(np.float16)
    (tmp_path / "critical").mkdir()
    np.save(tmp_path / "normal.npy", x)
    np.save(tmp_path / "critical" / "scratch.npy", x[:2])
    np.save(tmp_path / "negative.npy", x[:1])
    bank = files.bank_directory(spark, str(tmp_path))
    assert {(r.tier, r.label, r["count"]) for r in bank.groupBy("tier", "label").count().collect()} == {("normal", "", 5), ("critical", "scratch", 2), ("negative", "_default", 1)}
    root = f"{tmp_path}/bank"
    files.save_bank(bank, root)
    assert sorted(map(str, files.load_bank(spark, root).collect())) == sorted(map(str, bank.collect()))
    files.save_bank(bank.where("tier <> 'negative'"), root)
    assert files.load_bank(spark, root).count() == 7
    manifest = files.export_package(bank, None, f"{tmp_path}/package").first()
    assert manifest.rows == 8 and manifest.dim == 4 and spark.read.parquet(f"{tmp_path}/package/codes").count() == 8


def test_streamed_hits_equal_a_batch(spark, tmp_path):
    schema = "tier string, label string, entry bigint, row bigint, inspection bigint"
    hits = [("critical", "d1", i % 3, i % 2, i // 4) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(hits[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).json(f"{tmp_path}/in")
    query = st.hit_counts(stream).writeStream.outputMode("update").format("memory").queryName("hit_counts").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.entry, r.row): (r.hits, r.last) for r in spark.table("hit_counts").groupBy("entry", "row").agg(F.max("hit_count").alias("hits"), F.max("last_hit").alias("last")).collect()}
    want = {}
    for _, _, entry, row, inspection in set(hits):
        n, last = want.get((entry, row), (0, -1))
        want[entry, row] = n + 1, max(last, inspection)
    assert got == want


LOG_EVENTS = "log string, seq bigint, kind string, id string, ts bigint, file string"


def test_capped_log(spark, tmp_path):
    """Batches of adds, deletes and clears against a plain list; files fall out with their records, and nothing piles up."""
    import random

    rng, seq, lists, files_of = random.Random(3), 0, {}, tmp_path / "files"
    files_of.mkdir()
    (tmp_path / "outside.png").write_bytes(b"x")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(LOG_EVENTS).json(f"{tmp_path}/in")
    for k in range(5):
        events = []
        for _ in range(30):
            log, kind = rng.choice("ab"), rng.choice(["add"] * 8 + ["delete", "clear"] * (k > 1))
            own = lists.setdefault(log, [])
            if kind == "add":
                id_ = f"i{rng.randrange(10**6)}" if rng.random() < 0.9 or not own else own[0][0]
                events.append((log, seq, kind, id_, seq // 3, f"{id_}.png" if id_ != "i0" else "../outside.png"))
                if id_ not in {x[0] for x in own}:
                    (files_of / f"{id_}.png").write_bytes(b"x")
                    own.append((id_, seq // 3))
            elif kind == "delete":
                id_ = rng.choice(own)[0] if own and rng.random() < 0.8 else "unknown"
                events.append((log, seq, kind, id_, None, None))
                lists[log] = [x for x in own if x[0] != id_]
            else:
                events.append((log, seq, kind, None, None, None))
                lists[log] = []
            seq += 1
        lists = {log: own[-7:] for log, own in lists.items()}
        spark.createDataFrame(events, LOG_EVENTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = st.capped_log(stream, f"{tmp_path}/log", 7, f"{tmp_path}/c1", str(files_of)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {}
        for r in sorted(st.read_log(spark, f"{tmp_path}/log").collect(), key=lambda r: r.ts):
            got.setdefault(r.log, set()).add((r.id, r.ts))
        assert got == {log: set(own) for log, own in lists.items() if own}
        assert {p.stem for p in files_of.glob("*.png")} == {x[0] for own in lists.values() for x in own}
    assert len(list((tmp_path / "log").rglob("*.parquet"))) <= 2 and (tmp_path / "outside.png").exists()


def test_ingest(spark, tmp_path):
    schema = "id bigint, ts bigint"
    for k in range(3):
        spark.createDataFrame([(i, i // 2) for i in range(k * 10, k * 10 + 10)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    q = st.ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/store").count() == 30


def test_index_grows(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id bigint, vec array<double>").write.json(f"{tmp_path}/in")
    centers = spark.createDataFrame([(0, [0.0, 0.0]), (1, [19.0, 0.0])], "cluster int, center array<double>")
    asked = []
    stream = spark.readStream.schema("id bigint, vec array<double>").json(f"{tmp_path}/in")
    q = st.extend_index(stream, centers, 10, f"{tmp_path}/index", f"{tmp_path}/c", asked.append).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/index").where("cluster = 1").count() == 10 and asked == [20]


def test_features_of_images(spark):
    rng = np.random.default_rng(0)
    shapes = [(300, 400), (600, 1000)]
    images = [rng.integers(0, 255, (h, w, 3), dtype=np.uint8) for h, w in shapes]

    def saved(x):
        out = io.BytesIO()
        np.save(out, x)
        return out.getvalue()

    def encode(window):
        return window[: 37 * 14, : 37 * 14].reshape(37, 14, 37, 14, 3).mean(axis=(1, 3)).reshape(-1, 3)

    t = spark.createDataFrame([(i, saved(x)) for i, x in enumerate(images)] + [(9, b"bad")], "entry bigint, content binary")
    found = {}
    for r in files.extracted(t, lambda b: None if b == b"bad" else np.load(io.BytesIO(b)), encode).collect():
        found.setdefault(r.entry, {})[r.row] = r.vec
    assert {k: len(v) for k, v in found.items()} == {0: 1369, 1: 6 * 1369}
    assert np.allclose(found[1][0], images[1][:14, :14].mean(axis=(0, 1)), rtol=1e-3)
    assert np.allclose(found[1][1369 * 5 + 1368], images[1][-14:, -14:].mean(axis=(0, 1)), rtol=1e-3)
    assert np.allclose(found[0][22 * 37], np.pad(images[0], ((0, 218), (0, 118), (0, 0)), mode="reflect")[308:322, :14].mean(axis=(0, 1)), rtol=1e-3)


def test_import_is_checked(spark, tmp_path):
    import pytest

    bank = spark.createDataFrame([("normal", "", 0, [1.0, 2.0]), ("critical", "a", 0, [1.0, 2.0])], "tier string, label string, row int, vec array<double>")
    files.save_bank(bank, f"{tmp_path}/one")
    files.import_bank(spark, f"{tmp_path}/one", f"{tmp_path}/two")
    assert files.load_bank(spark, f"{tmp_path}/two").count() == 2
    for k, wrong in enumerate((bank.withColumn("tier", F.lit("x")), bank.drop("row"), bank.withColumn("vec", F.when(F.col("tier") == "normal", F.col("vec")).otherwise(F.array(F.lit(1.0)))))):
        files.save_bank(wrong, f"{tmp_path}/w{k}")
        with pytest.raises(ValueError, match="unknown|missing"):
            files.import_bank(spark, f"{tmp_path}/w{k}", f"{tmp_path}/three")
