"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A signature needs two permutations of the 32-bit shingle ids: the first scatters
them, the second is applied to them shifted circularly by 0, 1, 2, ... and each
shift's minimum is one coordinate. 40 bands of 6 coordinates make candidates;
at a similarity of 0.8 a pair is missed with a chance of 5e-6. Every link is
confirmed on the full sets of 64-bit shingle ids.

Equal shingle sets are first put together, so copies cost one row. The texts that
share a bucket with another set (and no others) have their ids written once. The
number of stages is fixed:
  1. each member of a bucket is compared with the bucket's smallest id, and the
     links found give components;
  2. buckets that lie in several components are left, equal ones once. All their
     pairs are still open but those within one component, and so those within the
     bucket's largest component. Each other member is compared with whatever isn't
     yet in its component, in tiles of bounded bytes of members against bounded
     bytes of members, each with a union-find of its own;
  3. the components of components are found once.
So no pairs of a group are emitted, nothing is dropped or capped, and a group of
near copies costs about one comparison a member.

Defined cases: null or blank texts have no shingles and stay alone; texts shorter
than a shingle have one, the whole sequence; null ids are their own group;
repeated rows (one id twice) get the same answer; rows of one id with different
texts are each judged by their own text; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.llm.common import map_texts, materialise
from patchlake.llm.components import components

BANDS, ROWS = 40, 6
SHINGLE, PERCENT = 4, 80
#: A tile holds about so many ids of its members, and as many of what they are compared with (8 bytes each).
TILE_IDS = 1 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
HASHES = [T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("n", T.LongType())]
SKETCH = T.StructType([*HASHES, T.StructField("bands", T.ArrayType(T.LongType()))])
SET = T.StructType([*HASHES, T.StructField("ids", T.ArrayType(T.LongType()))])
#: Two odd constants of a public 32-bit finaliser, and odd 64-bit multipliers.
MIX = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SEEDS = np.uint32(0x5BD1E995), np.uint32(0x1B873593)


def permuted(x: np.ndarray, seed: np.uint32) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ seed
    x ^= x >> np.uint32(16)
    x *= MIX[0]
    x ^= x >> np.uint32(13)
    x *= MIX[1]
    x ^= x >> np.uint32(16)
    return x


def shingle_ids(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """64-bit ids of the distinct shingles."""
    if not words:
        return np.empty(0, np.uint64)
    get = known.get
    codes = np.array([get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    n = max(1, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(codes))):
        out = (out ^ codes[k : k + n]) * ODD[k & 1]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(ids: np.ndarray, coordinates: int = BANDS * ROWS, block: int = 1 << 17) -> np.ndarray:
    scattered = permuted((ids >> np.uint64(32)).astype(np.uint32) ^ ids.astype(np.uint32), SEEDS[0])
    shifts = np.arange(coordinates, dtype=np.uint32)
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    step = max(1, block // coordinates)
    for i in range(0, len(scattered), step):
        np.minimum(out, permuted(shifts[:, None] + scattered[None, i : i + step], SEEDS[1]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * ODD[k & 1]
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def sketcher(size: int, full: bool):
    """Of each text: a 128-bit digest of its set of shingles, the set's size, and its band keys or, with `full`, its ids."""
    known: dict[bytes, int] = {}

    def work(texts: list) -> list:
        f1, f2, n, last = [], [], [], []
        if len(known) > 100_000:
            known.clear()
        for t in texts:
            ids = shingle_ids(words_of(t), size, known)
            whole = xxhash.xxh3_128_digest(ids.tobytes())
            f1.append(int.from_bytes(whole[:8], "little", signed=True))
            f2.append(int.from_bytes(whole[8:], "little", signed=True))
            n.append(len(ids))
            last.append(ids.view(np.int64) if full else band_keys(signature(ids)) if len(ids) else None)
        return [f1, f2, n, last]

    return work


def shingles(text: str | None, size: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def linked_parts(percent: int, tile: pa.Table) -> pa.Table:
    """Links between parts (a, b), enough to join all that are linked. tile: part, ask (compare it with all others), ids."""
    ids = tile.column("ids").combine_chunks()
    flat, ends = ids.values.to_numpy(zero_copy_only=False)[ids.offsets[0].as_py() :], np.diff(ids.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(ends)])
    flat = np.unique(flat[: starts[-1]], return_inverse=True)[1].astype(np.int32)
    parts, root = np.unique(tile.column("part").to_numpy(), return_inverse=True)
    ask, found = tile.column("ask").to_numpy(), []
    own = np.zeros(len(flat), bool)  # one place for each id of the tile
    for i in np.flatnonzero(ask):
        n = ends[i]
        others = np.flatnonzero((root != root[i]) & (100 * np.minimum(ends, n) >= percent * np.maximum(ends, n)))
        if not len(others):
            continue
        own[flat[starts[i] : starts[i + 1]]] = True
        length = ends[others]
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = np.repeat(starts[others] - begin, length) + np.arange(length.sum())
        both = np.add.reduceat(own[flat[at]].astype(np.int64), begin)
        own[flat[starts[i] : starts[i + 1]]] = False
        near = others[100 * both >= percent * (n + length - both)]
        for r in np.unique(root[near]):
            found.append((parts[root[i]], parts[r]))
            root[root == r] = root[i]
    a, b = ([f[k] for f in found] for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between each bucket's smallest id and its other members. members: key, hub, node; sets: node, n, ids."""
    n = sets.select("node", "n")
    pairs = members.select(F.col("hub").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    pairs = pairs.join(n.toDF("b", "m"), "b").join(n.toDF("a", "n"), "a").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("ids").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("ids").alias("x")), "a")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.where((100 + percent) * both >= percent * (F.size("x") + F.size("y"))).select("a", "b")


def open_buckets(members: DataFrame, tile_ids: int) -> DataFrame:
    """key, most (the largest part), blocks, ask_blocks: one of each group of equal buckets that lie in several parts. members: key, node, n, part."""
    parts = members.groupBy("key", "part").agg(
        F.count("*").alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    buckets = parts.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("w", "part")).alias("most")
    )
    once = buckets.where("parts > 1").groupBy("c", "x", "y", "w", "most").agg(F.min("key").alias("key"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / tile_ids)).cast("int")
    return once.select("key", F.col("most.part").alias("most"), blocks(F.col("w")).alias("blocks"), blocks(F.col("w") - F.col("most.w")).alias("ask_blocks"))


def tile_links(members: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between parts within buckets. members: key, node, part; buckets as from open_buckets; sets: node, ids."""
    rows = members.join(buckets, "key").withColumn("other", F.col("part") != F.col("most"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    whole = F.expr("blocks = 1 and ask_blocks = 1")
    compared = rows.select("key", "node", "part", (F.col("other") & whole).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("i"), block("blocks").alias("j"))
    asking = rows.where(F.col("other") & ~whole).select("key", "node", "part", F.lit(True).alias("ask"), block("ask_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    tiles = compared.unionByName(asking).join(sets.select("node", "ids"), "node").select("key", "i", "j", "part", "ask", "ids")

    def links(tile: pa.Table) -> pa.Table:
        return linked_parts(percent, tile)

    return tiles.groupBy("key", "i", "j").applyInArrow(links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, tile_ids: int = TILE_IDS) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable over links), kept (true for that one)."""
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    sketch = map_texts(source, partial(sketcher, shingle, False), SKETCH, "text", ["id"], "s").select("id", "s.*")
    sketch = materialise(sketch, "sketch")
    usable = (F.col("n") > 0) & F.col("id").isNotNull()
    distinct = sketch.where(usable).groupBy("f1", "f2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    distinct = materialise(distinct, "distinct")
    entries = distinct.select(F.explode("bands").alias("key"), "node", "f1", "f2")
    shared = materialise(entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1"), "shared")
    members = materialise(entries.join(shared, "key").select("key", "hub", "node", "f1", "f2"), "members")
    wanted = members.select(F.col("node").alias("id"), F.col("f1").alias("w1"), F.col("f2").alias("w2")).distinct()
    sets = map_texts(source.join(wanted, "id"), partial(sketcher, shingle, True), SET, "text", ["id", "w1", "w2"], "s").where("s.f1 = w1 and s.f2 = w2")
    sets = materialise(sets.select(F.col("id").alias("node"), "s.f1", "s.n", "s.ids").dropDuplicates(["node", "f1"]), "sets")
    found = components(materialise(star_links(members, sets, percent), "stars"))
    part = found.toDF("node", "part")
    members = members.join(sets.select("node", "f1", "n"), ["node", "f1"]).join(part, "node", "left").select("key", "node", "n", F.coalesce("part", "node").alias("part"))
    members = materialise(members, "parts")
    buckets = materialise(open_buckets(members, tile_ids), "open")
    more = components(materialise(tile_links(members, buckets, sets, percent), "tiles"))
    merged = found.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id")).unionByName(found)
    alone = more.join(merged.select("id"), "id", "left_anti")  # linked in tiles only
    merged = merged.join(more.toDF("component", "last"), "component", "left").select("id", F.coalesce("last", "component").alias("component")).unionByName(alone)
    grouped = distinct.select("f1", "f2", "node", "copies").join(merged.toDF("node", "component"), "node", "left")
    grouped = grouped.where("copies > 1 or component is not null").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    out = sketch.select("id", "f1", "f2", "n").join(grouped, ["f1", "f2"], "left")
    component = F.when(usable, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
