"""Commits of several writers, crashes before a commit, ids that never come back, and the folder format."""

import io
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.sources import bank_format as b
from patchlake.sources import files, versions
from patchlake.sources.versions import FeatureStore, commit, numbers, sweep, version


def test_one_of_many_writers_creates_a_version(spark, tmp_path):
    root, lost = str(tmp_path), []

    def write(k):
        for i in range(8):
            commit(spark, root, lambda now, v=f"{k}-{i}": now | {"all": now.get("all", []) + [v]})

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = version(spark, root)
    assert now["number"] == 32 and sorted(now["all"]) == sorted(f"{k}-{i}" for k in range(4) for i in range(8)) and not lost
    assert versions.created(spark, f"{root}/x", "one") and not versions.created(spark, f"{root}/x", "two") and (tmp_path / "x").read_text() == "one"
    assert not list(tmp_path.rglob("*.tmp"))


def batch(spark, images, start=0):
    return spark.createDataFrame([(i, f"photo{i % 2}.png", r, [float(start + i), float(r)]) for i in images for r in range(i % 3 + 1)], "image bigint, name string, row int, vec array<double>")


def test_store_with_two_writers(spark, tmp_path):
    root = str(tmp_path)
    given = {0: [], 1: []}

    def write(k):
        store = FeatureStore(spark, root)
        for i in range(3):
            given[k] += [r.id for r in store.add(batch(spark, range(4), 100 * k + 10 * i)).collect()]

    threads = [threading.Thread(target=write, args=(k,)) for k in given]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = FeatureStore(spark, root)
    ids = [r.id for r in store.entries().collect()]
    assert sorted(ids) == sorted(given[0] + given[1]) == [f"{i:06d}" for i in range(1, 25)]
    rows = store.features().join(store.entries(), "id").groupBy("id", "rows").count().collect()
    assert len(rows) == 24 and all(r["count"] == r.rows for r in rows)


def test_ids_do_not_come_back_and_removal(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert store.entries() is None and store.features() is None and store.remove(ask("000001")) == 0
    assert store.add(batch(spark, [])) is None and numbers(spark, store.root) == []
    store.add(batch(spark, range(3)))
    assert store.remove(ask("000003", "000003", "000099")) == 1 and store.remove(ask("000003")) == 0
    assert sorted(r.id for r in store.entries().collect()) == ["000001", "000002"]
    assert [r.id for r in store.add(batch(spark, [5])).collect()] == ["000004"]
    assert {r.id for r in store.of(ask("000003", "000004")).collect()} == {"000004"}
    before = sorted(map(str, store.features().collect()))
    store.compact()
    assert sorted(map(str, store.features().collect())) == before and version(spark, store.root)["removed"] == []
    with pytest.raises(ValueError, match="other columns"):
        store.add(batch(spark, [1]).withColumn("more", F.lit(1)))


def test_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/bank"
    bank = spark.createDataFrame([("normal", "", 0, [1.0]), ("critical", "a", 0, [2.0])], "tier string, label string, row int, vec array<double>")
    files.save_bank(bank, root)
    before = files.load_bank(spark, root).collect()

    def crash(*_):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(versions, "created", crash)
        with pytest.raises(RuntimeError):
            files.save_bank(bank.limit(1), root)
        with pytest.raises(RuntimeError):
            FeatureStore(spark, root).add(batch(spark, [1]))
    assert files.load_bank(spark, root).collect() == before
    assert len(list((tmp_path / "bank").iterdir())) == 3 and sweep(spark, root) == []
    assert len(sweep(spark, root, older_than=0)) == 1 and files.load_bank(spark, root).collect() == before


def test_updates_are_made_again(spark, tmp_path):
    root = f"{tmp_path}/bank"
    files.save_bank(spark.createDataFrame([("normal", "", 0)], "tier string, label string, row int"), root)
    runs = []

    def slow(bank):
        if not runs:  # another writer is faster the first time
            files.update_bank(spark, root, lambda x: x.unionByName(x.withColumn("row", F.col("row") + 10)))
        runs.append(1)
        return bank.unionByName(bank.withColumn("row", F.col("row") + 1))

    files.update_bank(spark, root, slow)
    assert len(runs) == 2 and sorted(r.row for r in files.load_bank(spark, root).collect()) == [0, 1, 10, 11]
    assert files.load_bank(spark, root, 1).count() == 1
    sweep(spark, root, kept=1, older_than=0)
    assert len(numbers(spark, root)) == 1 and files.load_bank(spark, root).count() == 4


# ---- the folder format


def saved(path):
    out = {}
    for f in sorted(path.rglob("*")):
        if f.is_file():
            out[str(f.relative_to(path))] = f.read_bytes()
    return out


def made(tmp_path):
    """A folder as another tool writes it: one label without metadata, one with too few rows of it, the negative tier in the older layout."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).astype(np.float16)
    (tmp_path / "critical").mkdir(parents=True)
    np.save(tmp_path / "bank.npy", x[:500])
    for label, rows in (("scratch", x[500:700]), ("dent", x[700:750]), ("stain", x[750:760])):
        np.save(tmp_path / "critical" / f"{label}.npy", rows)
    np.save(tmp_path / "negative_bank.npy", x[800:])
    kinds = {name: kind for name, kind, _ in b.META}
    meta = {n: (np.arange(200) % 7 + k).astype(kinds[n]) for k, n in enumerate(kinds)}
    np.savez(tmp_path / "critical" / "scratch.meta.npz", **meta)
    np.savez(tmp_path / "critical" / "dent.meta.npz", **{n: v[:3] for n, v in meta.items()})
    manifest = {"inspection_count": 77, "model": "m", "normal_image_index": [{"name": "a.png", "start": 0, "count": 300}, {"name": "b.png", "start": 310, "count": 190, "entry_id": "000002"}]}
    manifest["critical_image_index"] = {"scratch": [{"name": "c.png", "start": 0, "count": 200, "kept": list(range(5, 205))}]}
    (tmp_path / "bank_meta.json").write_text(json.dumps(manifest))
    return x, meta


def test_reading_a_folder(spark, tmp_path):
    x, meta = made(tmp_path)
    bank = b.read_folder(spark, str(tmp_path), part_rows=64)
    rows = {(r.tier, r.label, r.row): r for r in bank.collect()}
    assert len(rows) == 500 + 260 + 100
    assert all(rows["normal", "", i].vec == x[i].astype(np.float32).tolist() and rows["normal", "", i].severity is None for i in range(500))
    assert [rows["normal", "", i].name for i in (0, 299, 300, 309, 310)] == ["a.png", "a.png", None, None, "b.png"] and rows["normal", "", 499].entry == "000002"
    for i in range(200):
        r = rows["critical", "scratch", i]
        assert (r.severity, r.registered_at, r.last_hit, r.hit_count, r.memory, r.place, r.healed) == (*(int(v[i]) for v in meta.values()), i + 5, False)
    assert all((r.severity, r.registered_at, r.last_hit, r.hit_count, r.memory, r.healed) == (2, 77, 77, 0, 0, True) for k, r in rows.items() if k[1] in ("dent", "stain", "_default"))
    assert rows["negative", "_default", 0].vec == x[800].astype(np.float32).tolist()


def test_wanted_tiers_and_labels(spark, tmp_path):
    made(tmp_path)
    some = b.read_folder(spark, str(tmp_path), ["critical"], ["dent", "stain"], 64)
    assert some.rdd.getNumPartitions() == 2 and some.count() == 60
    assert b.read_folder(spark, str(tmp_path), ["normal"], part_rows=64).rdd.getNumPartitions() == 8
    assert b.read_folder(spark, str(tmp_path), ["other"]).count() == 0 and b.read_folder(spark, str(tmp_path), labels=[]).count() == 0
    bank = b.read_folder(spark, str(tmp_path))
    both = bank.where("label = 'dent'").unionByName(bank.where("label = 'stain'"))
    assert {r.label: r["count"] for r in both.groupBy("label").count().collect()} == {"dent": 50, "stain": 10}


def test_saving_named_tiers(spark, tmp_path):
    x, _ = made(tmp_path / "one")
    bank = b.read_folder(spark, f"{tmp_path}/one").drop("healed")
    b.write_folder(bank, f"{tmp_path}/two", inspection_count=80)
    back = b.read_folder(spark, f"{tmp_path}/two")
    key = ["tier", "label", "row", "name", "place", "vec"]
    assert sorted(map(str, back.select(*key).collect())) == sorted(map(str, bank.select(*key).collect()))
    assert not back.where("healed").count()
    before = saved(tmp_path / "two")
    assert np.array_equal(np.load(tmp_path / "two" / "bank.npy"), x[:500]) and json.loads(before["bank_meta.json"])["inspection_count"] == 80
    # one tier: a label goes, one comes, the others' bytes stay
    changed = back.where("tier = 'critical' and label = 'dent'").unionByName(back.where("tier = 'critical' and label = 'stain'").withColumn("label", F.lit("new")))
    changed.write.parquet(f"{tmp_path}/changed")
    b.write_folder(spark.read.parquet(f"{tmp_path}/changed"), f"{tmp_path}/two", ("critical",))
    after = saved(tmp_path / "two")
    assert {n for n in after if n.startswith("critical/") and not n.endswith(".crc")} == {f"critical/{n}{e}" for n in ("dent", "new") for e in (".npy", ".meta.npz")}
    assert all(after[n] == before[n] for n in before if n.startswith(("bank.npy", "negative/")))
    index = json.loads(after["bank_meta.json"])
    assert set(index["critical_image_index"]) == {"dent", "new"} and index["normal_image_index"] and index["inspection_count"] == 80
    b.write_folder(spark.read.parquet(f"{tmp_path}/changed").where("false"), f"{tmp_path}/two", ("critical", "negative"))
    assert {r.tier for r in b.read_folder(spark, f"{tmp_path}/two").select("tier").distinct().collect()} == {"normal"}


def test_older_files_go_with_the_next_save(spark, tmp_path):
    made(tmp_path)
    rows = b.read_folder(spark, str(tmp_path)).where("tier = 'negative'")
    rows.write.parquet(f"{tmp_path}/kept")
    b.write_folder(spark.read.parquet(f"{tmp_path}/kept"), str(tmp_path), ("negative",))
    assert not (tmp_path / "negative_bank.npy").exists() and len(np.load(tmp_path / "negative" / "_default.npy")) == 100


def test_a_job_that_fails_leaves_the_old_bank(spark, tmp_path):
    made(tmp_path)
    before = saved(tmp_path)
    bad = spark.createDataFrame([("critical", "a", 0, [1.0, 2.0]), ("critical", "a", 1, [1.0])], "tier string, label string, row int, vec array<double>")
    with pytest.raises(Exception, match="several lengths"):
        b.write_folder(bad, str(tmp_path))
    assert saved(tmp_path) == before


def test_metadata_alone(spark, tmp_path):
    made(tmp_path)
    before = saved(tmp_path)
    bank = b.read_folder(spark, str(tmp_path)).where("tier = 'critical'").withColumn("hit_count", F.col("row") + 3)
    bank.drop("vec").write.parquet(f"{tmp_path}/meta")
    b.write_metadata(spark.read.parquet(f"{tmp_path}/meta"), str(tmp_path), "critical", 90)
    after = {k: v for k, v in saved(tmp_path).items() if not k.startswith("meta/")}
    assert {k for k in after if after[k] != before.get(k)} == {"bank_meta.json", "critical/dent.meta.npz", "critical/scratch.meta.npz", "critical/stain.meta.npz"}
    got = b.read_folder(spark, str(tmp_path)).where("tier = 'critical'")
    assert got.where("hit_count <> row + 3 or healed").count() == 0 and got.count() == 260
    assert np.load(io.BytesIO(after["critical/dent.meta.npz"]))["hit_count"].dtype == np.uint32
    with pytest.raises(ValueError, match="rows of metadata"):
        b.write_metadata(spark.read.parquet(f"{tmp_path}/meta").where("row > 0"), str(tmp_path), "critical")
    with pytest.raises(ValueError, match="normal"):
        b.write_metadata(spark.read.parquet(f"{tmp_path}/meta"), str(tmp_path), "normal")


def test_an_empty_folder(spark, tmp_path):
    assert b.read_folder(spark, str(tmp_path / "none")).count() == 0
    np.save(tmp_path / "bank.npy", np.zeros((0, 4), np.float16))
    assert b.read_folder(spark, str(tmp_path)).count() == 0
