"""Round trips, digests, revisits and equal bytes of equal input."""

import gzip
import hashlib
import random
from pathlib import Path

import pytest

from patchlake.llm.warc import new_root, read_warc, write_warc


def pages(spark):
    rng = random.Random(9)
    rows = [(i, f"http://h{i % 7}.example/{i}", "".join(rng.choice("<p>abc é\r\n\n") for _ in range(rng.randint(0, 400)))) for i in range(120)]
    rows += [(i, "u", rows[5][2] + "x" * 100) for i in (300, 200, 250)] + [(400, None, None), (401, "", ""), (402, "a\r\nb", "short"), (403, "b", "short"), (404, "l", "long " * 200_000), (None, "n", "y" * 150), (405, "n", "y" * 150), (405, "n", "y" * 150)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    root = new_root(spark)
    manifest = write_warc(df, root, shard_bytes=8000, roll_bytes=3000)
    back = read_warc(manifest, root, with_body=True).collect()
    assert len(back) == len(rows) and manifest.count() > 5
    bodies = {}
    for i, _, html in rows:
        bodies.setdefault(i, set()).add((html or "").encode())
    for r in back:
        body = next(iter(bodies[r.page_id]))
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        assert bytes(r.body) == (b"" if r.record_type == "revisit" else body)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in back}
    assert {(200, "response", None), (250, "revisit", 200), (300, "revisit", 200), (402, "response", None), (403, "response", None), (405, "response", None), (None, "revisit", 405)} <= kinds


def test_equal_input_gives_equal_files(spark):
    df, _ = pages(spark)
    seen = []
    for t in (df, df.repartition(7)):
        root = new_root(spark)
        write_warc(t, root, shard_bytes=8000, roll_bytes=3000)
        folder = Path(root.removeprefix("file://"))
        assert not list(folder.glob("_temporary-*"))
        seen.append({p.name: p.read_bytes() for p in folder.glob("*.warc.gz")})
    assert seen[0] == seen[1]
    assert all(gzip.decompress(x).startswith(b"WARC/1.1\r\n") for x in seen[0].values())


def test_manifest_names_what_counts(spark):
    df, rows = pages(spark)
    root = new_root(spark)
    manifest = write_warc(df, root)
    folder = Path(root.removeprefix("file://"))
    for r in manifest.collect():
        assert hashlib.sha256((folder / r.file).read_bytes()).hexdigest() == r.sha256
    (folder / "shard-999999-000000.warc.gz").write_bytes(b"left by a lost task")
    assert read_warc(manifest, root).count() == len(rows)


def test_damage_is_found(spark):
    df, _ = pages(spark)
    root = new_root(spark)
    manifest = write_warc(df, root)
    path = Path(root.removeprefix("file://")) / manifest.first()["file"]
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="archive|Error|digest"):
        read_warc(manifest, root).collect()


def test_empty_table(spark):
    df, _ = pages(spark)
    root = new_root(spark)
    assert read_warc(write_warc(df.where("false"), root), root).count() == 0


def test_clumped_ids_and_one_id_give_shards_of_even_size(spark):
    rng = random.Random(4)
    clumps = [*range(300), *range(10**12, 10**12 + 300), *[7 * 10**12] * 200]
    rows = [(i, "u", f"{rng.random()} " * 20) for i in clumps]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    root = new_root(spark)
    manifest = write_warc(df, root, shard_bytes=20_000)
    sizes = {}
    for r in read_warc(manifest, root, with_body=True).collect():
        shard = r.file.split("-")[1]
        sizes[shard] = sizes.get(shard, 0) + r.payload_bytes + 512
    assert len(sizes) > 20 and max(sizes.values()) < 2 * 20_000


def test_revisits_name_the_response(spark):
    df = spark.createDataFrame([(1, "a", "x" * 200), (2, "b", "x" * 200)], "page_id bigint, url string, html string")
    root = new_root(spark)
    manifest = write_warc(df, root)
    heads = gzip.decompress((Path(root.removeprefix("file://")) / manifest.first()["file"]).read_bytes()).decode().split("WARC/1.1\r\n")[1:]
    fields = [dict(x.split(": ", 1) for x in h.partition("\r\n\r\n")[0].split("\r\n")) for h in heads]
    assert fields[1]["WARC-Refers-To"] == fields[0]["WARC-Record-ID"] != fields[1]["WARC-Record-ID"]
