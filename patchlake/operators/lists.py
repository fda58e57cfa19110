"""Inverted lists: a bank kept by cluster, searched list by list, extended, and checked against the bank.

An index lives below a root, in versions (`patchlake.sources.versions`): centroids, a
folder of lists by cluster (large ones in several files), and a basis, which says for each
entry how many rows it had and a digest of them. `refreshed` compares the basis with the
bank: with nothing changed the index stays, with new entries only their rows are assigned
to the nearest clusters and put beside the others, and with entries that are gone or
changed, or too much growth, it is built anew.

A search with few probes sends each query to its `nprobe` nearest clusters' lists: queries are dealt out
by cluster (and, where a cluster has many, by part of it), a task reads one list after
the other in blocks of bounded bytes and gives back the k smallest distances of each
query and list. These short lists are merged by query, so the bank isn't shuffled, pairs
of vectors nowhere exist and no window sorts pairs. With many probes (`SCAN_SHARE`) queries would be
repeated too often: tasks then take batches of queries over all lists, each list with those that
probe it, and with as many probes as clusters the search is the full scan. Queries for which no row is left
are searched in the whole bank.

`exact_mean` is the full scan's answer for rows that cluster: the bank is dealt to regions about centers drawn
far from each other, and a query leaves out a region if the triangle inequality says that each of its rows is farther than the k
nearest so far. Centers decide the time only, never the rows; without clusters nearly all regions are read, which is slower than `nearest_mean`.

Defined cases: an index without rows answers null; queries with one id are one query; ties don't
matter, as only distances are given; fewer than k rows give the mean over these; clusters
without rows have no list.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.operators.clusters import MOST_CLUSTERS, NPROBE, ROUNDS, SEED, TILE_BYTES, assign, build, n_clusters, nearest_centers, needs_rebuild, probes
from patchlake.operators.knn import dealt, keep_least, left_out, means, measured, nearer, nearest_mean, norms, prepared, settled, single, squares, tiles, vectors
from patchlake.sources.shared import materialise, scratch_path
from patchlake.sources.versions import commit, version

#: With more probes than one cluster in so many, tasks go over all lists.
SCAN_SHARE = 8
#: Rows of a file of a list.
FILE_ROWS = 1 << 17
#: Queries that one task searches in one list, about; sampled queries that tell how many a list gets.
GROUP, SAMPLED = 1 << 16, 100_000
#: Queries that go over a list together, and bytes of a list's block.
TOGETHER, BLOCK_BYTES = 8192, 16 << 20
#: Bytes of sampled rows among which centers of regions are drawn.
DRAWN_BYTES = 8 << 20


@dataclass
class Lists:
    """An index that can be searched: where its lists lie, and centroids (cluster, center)."""

    root: str
    folders: list[str]
    centroids: DataFrame

    def rows(self) -> DataFrame:
        read = self.centroids.sparkSession.read
        return reduce(DataFrame.unionByName, [read.parquet(f"{self.root}/{f}") for f in self.folders])


def opened(spark: SparkSession, root: str, number: int | None = None) -> Lists:
    now = version(spark, root, number)
    return Lists(root, now["lists"], spark.read.parquet(f"{root}/{now['centroids']}"))


def listed(bank: DataFrame, centroids: DataFrame) -> Lists:
    """An index for this session over a bank with its clusters (entry, row, vec, cluster)."""
    root = scratch_path(bank.sparkSession, "lists")
    write_lists(bank, f"{root}/lists")
    return Lists(root, ["lists"], centroids)


def basis(rows: DataFrame) -> DataFrame:
    """entry, n, digest: what an index has to know of a bank. rows: entry, row, vec."""
    return rows.groupBy("entry").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", "vec")).alias("digest"))


def write_lists(assigned: DataFrame, path: str) -> None:
    """A folder for each cluster; a list of more than FILE_ROWS rows is written by several tasks."""
    counts = materialise(assigned.groupBy("cluster").agg(F.count("*").alias("n")), "counts")
    parts = counts.select("cluster", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("parts"))
    put = assigned.join(F.broadcast(parts), "cluster").withColumn("part", F.pmod(F.xxhash64("entry", "row"), F.col("parts")))  # a row for each cluster
    put.repartition("cluster", "part").drop("part", "parts").write.partitionBy("cluster").parquet(path)


def built(rows: DataFrame, root: str, k: int | None = None, rounds: int = ROUNDS, seed: int = SEED) -> dict:
    """A new index over the rows (entry, row, vec and, for groups, grp) as the newest version; what it says."""
    spark = rows.sparkSession
    rows = materialise(dealt(rows), "rows")  # read by every round
    name = uuid.uuid4().hex
    build(rows, k, rounds, seed).write.parquet(f"{root}/centroids-{name}")
    centers = spark.read.parquet(f"{root}/centroids-{name}")
    write_lists(assign(rows, centers), f"{root}/lists-{name}")
    basis(rows).write.parquet(f"{root}/basis-{name}")
    n = rows.count()
    new = {"centroids": f"centroids-{name}", "lists": [f"lists-{name}"], "basis": [f"basis-{name}"], "built_rows": n, "rows": n}
    return commit(spark, root, lambda _: new)


def extended(spark: SparkSession, root: str, rows: DataFrame) -> dict:
    """The index with the rows of new entries; made again if another writer was faster."""

    def more(now: dict) -> dict | None:
        held = spark.read.parquet(*[f"{root}/{b}" for b in now["basis"]]).select("entry")
        fresh = materialise(dealt(rows.join(held, "entry", "left_anti").select(rows.columns)), "fresh")
        n = fresh.count()
        if not n:
            return None
        name = uuid.uuid4().hex
        write_lists(assign(fresh, spark.read.parquet(f"{root}/{now['centroids']}")), f"{root}/lists-{name}")
        basis(fresh).write.parquet(f"{root}/basis-{name}")
        return now | {"lists": [*now["lists"], f"lists-{name}"], "basis": [*now["basis"], f"basis-{name}"], "rows": now["rows"] + n}

    return commit(spark, root, more)


def refreshed(rows: DataFrame, root: str, k: int | None = None, rounds: int = ROUNDS) -> str:
    """Bring the index up to the bank: `kept`, `extended` or `built`."""
    spark, now = rows.sparkSession, version(rows.sparkSession, root)
    if not now.get("lists"):
        built(rows, root, k, rounds)
        return "built"
    wanted = materialise(basis(rows), "basis")
    held = spark.read.parquet(*[f"{root}/{b}" for b in now["basis"]])
    if held.join(wanted, ["entry", "n", "digest"], "left_anti").limit(1).count() or needs_rebuild(wanted.agg(F.sum("n")).first()[0] or 0, now["built_rows"]):
        built(rows, root, k, rounds)
        return "built"
    return "extended" if extended(spark, root, rows)["number"] != now["number"] else "kept"


def blocks(where: fs.FileSystem, folders: list[str], cluster: int, block_bytes: int) -> Iterator[pa.Table]:
    """A list's rows in blocks of bounded bytes."""
    for folder in folders:
        path = f"{folder}/cluster={cluster}"
        if where.get_file_info(path).type != fs.FileType.Directory:
            continue
        held, size = [], 0
        streamed = ds.ParquetFragmentScanOptions(use_buffered_stream=True, pre_buffer=False)  # else whole row groups of several files are read ahead
        for b in ds.dataset(path, filesystem=where, format="parquet").to_batches(batch_size=4096, batch_readahead=1, fragment_readahead=1, fragment_scan_options=streamed, use_threads=False):
            held.append(b)
            size += b.nbytes
            if size >= block_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def numbered(*columns: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The columns' values as numbers of one dictionary; nulls are -1."""
    plain = [pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in columns]
    codes = pa.chunked_array([x for c in plain for x in c.chunks], plain[0].type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    ends = np.cumsum([len(c) for c in plain])[:-1]
    return np.split(codes, ends)


def improved(best: np.ndarray, which: np.ndarray, q: np.ndarray, square: np.ndarray, asked: pa.Table, b: pa.Table, leave_out: str) -> None:
    """Put the squared distances of queries `which` (their rows of q, square and asked) to a block's rows into `best`, where they are among the least."""
    x = matrix(b.column("vec"))
    norm, step = norms(x), max(1, TILE_BYTES // (8 * max(1, len(x))))
    some = asked.take(pa.array(which)) if leave_out != "none" else None
    entry = numbered(some.column("entry"), b.column("entry")) if leave_out != "none" else None
    group = numbered(some.column("grp"), b.column("grp")) if leave_out == "group" else None
    for i in range(0, len(which), step):
        at = which[i : i + step]
        d = squares(q[at], square[at], x, norm)
        if entry is not None:
            own = entry[0][i : i + step, None] == entry[1][None, :]
            if group is not None:
                mine = group[0][i : i + step, None]
                own |= (mine == group[1][None, :]) & (mine >= 0)
            d[own] = np.inf
        near = best[at]
        keep_least(near, d)
        best[at] = near


def answers(asked: pa.Table, best: np.ndarray) -> pa.RecordBatch:
    """id and the distances found, of all of the best."""
    found = np.isfinite(best)
    ends = np.concatenate([[0], np.cumsum(found.sum(axis=1))])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(best[found]))
    return pa.RecordBatch.from_arrays([asked.column("id").combine_chunks(), lists], ["id", "d"])


def scanned(where_path: str, folders: list[str], centers: np.ndarray, ids: np.ndarray, nprobe: int, k: int, leave_out: str, block_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `searched`, but a task goes over all lists with the queries that probe them, so that queries aren't repeated for each probe. batches: id, entry, grp, vec."""
    where, _ = fs.FileSystem.from_uri(where_path)

    def answer(asked: pa.Table) -> pa.RecordBatch:
        q = matrix(asked.column("vec"))
        square, best, probed = norms(q), np.full((len(q), k), np.inf), np.zeros((len(ids), len(q)), bool)
        for i in range(0, len(q), 1024):
            near = np.searchsorted(ids, nearest_centers(q[i : i + 1024], centers, ids, nprobe)[1])
            probed[near, np.arange(i, i + len(near))[:, None]] = True
        for cluster, mask in zip(ids.tolist(), probed, strict=True):
            if mask.any():
                for b in blocks(where, folders, cluster, block_bytes):
                    improved(best, np.flatnonzero(mask), q, square, asked, b, leave_out)
        return answers(asked, settled(best, square))

    held: list[pa.RecordBatch] = []
    for b in batches:
        for i in range(0, b.num_rows, TOGETHER):
            if held and sum(h.num_rows for h in held) + min(TOGETHER, b.num_rows - i) > TOGETHER:
                yield answer(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(i, TOGETHER))
    if held and sum(h.num_rows for h in held):
        yield answer(pa.Table.from_batches(held))
    pa.default_memory_pool().release_unused()


def by_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Some rows of one cluster at a time, of batches ordered by cluster."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        clusters = b.column("cluster").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(clusters)) + 1).tolist(), len(clusters)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and (held[0].column("cluster")[0].as_py() != clusters[i] or sum(h.num_rows for h in held) >= TOGETHER):
                yield held[0].column("cluster")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield held[0].column("cluster")[0].as_py(), pa.Table.from_batches(held)


def searched(where_path: str, folders: list[str], k: int, leave_out: str, block_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and the k smallest distances of each query in its list. batches: cluster, id, entry, grp, vec, ordered by cluster."""
    where, _ = fs.FileSystem.from_uri(where_path)
    kept: tuple[int, list[pa.Table]] | None = None

    def of(cluster: int) -> Iterator[pa.Table]:
        """The list's blocks; one with a single block stays in memory for the next queries."""
        nonlocal kept
        if kept is not None and kept[0] == cluster:
            yield from kept[1]
            return
        seen = []
        for b in blocks(where, folders, cluster, block_bytes):
            seen = [*seen, b][:2]
            yield b
        kept = (cluster, seen) if len(seen) < 2 else None

    def answer(cluster: int, asked: pa.Table) -> pa.RecordBatch:
        q = matrix(asked.column("vec"))
        square, best = norms(q), np.full((len(q), k), np.inf)
        for b in of(cluster):
            improved(best, np.arange(len(q)), q, square, asked, b, leave_out)
        return answers(asked, settled(best, square))

    for cluster, asked in by_cluster(batches):
        yield answer(cluster, asked)
    pa.default_memory_pool().release_unused()


def parted(probed: DataFrame, asked: DataFrame, centroids: DataFrame, nprobe: int, n: int, group: int) -> DataFrame:
    """Queries (n of them) with their clusters and `part`: how many parts of about `group` queries each cluster has is told by a sample; any number gives the same rows."""
    every = max(1, n // SAMPLED)
    some = probes(asked.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), centroids, nprobe, ["id"])
    parts = some.groupBy("cluster").agg(F.ceil(F.count("*") * every / group).cast("int").alias("parts"))  # a row for each cluster
    return probed.join(F.broadcast(materialise(parts, "parts")), "cluster", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")


def routed(asked: DataFrame, index: Lists, k: int, nprobe: int, leave_out: str, block_bytes: int, n: int, where: str, folders: list[str], schema: T.StructType) -> DataFrame:
    """id and the least distances in each probed list: queries (n of them) are dealt out by cluster."""
    asked = dealt(asked)
    probed = probes(asked, index.centroids, nprobe).drop("probe")
    probed = parted(probed, asked, index.centroids, nprobe, n, GROUP) if n > GROUP else probed.withColumn("part", F.lit(0))
    sorted_ = probed.repartition("cluster", "part").sortWithinPartitions("cluster")
    return sorted_.select("cluster", "id", "entry", "grp", "vec").mapInArrow(partial(searched, where, folders, k, leave_out, block_bytes), schema)


def searched_mean(queries: DataFrame, index: Lists, k: int = 5, nprobe: int = NPROBE, leave_out: str = "none", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id and score: the mean distance to the k nearest rows of the nprobe nearest lists. queries: id (distinct), vec and, where left out, entry (and grp). leave_out: none, entry or group; groups that are '' or null leave nobody out."""
    group = F.when(F.col("grp") != "", F.col("grp")) if leave_out == "group" else F.lit(None).cast("string")
    clusters, nprobe = index.centroids.count(), max(1, nprobe)
    if clusters and nprobe >= clusters:  # every list: the full scan
        return nearest_mean(queries.dropDuplicates(["id"]), index.rows(), k, leave_out, ["id"])
    asked = queries.select("id", (F.lit(None).cast("bigint") if leave_out == "none" else F.col("entry")).alias("entry"), group.alias("grp"), "vec")
    where = index.root if "://" in index.root else "file://" + index.root.removeprefix("file:")
    base = fs.FileSystem.from_uri(where)[1]
    folders = [f"{base}/{f}" for f in index.folders]
    schema = T.StructType([queries.schema["id"], T.StructField("d", T.ArrayType(T.DoubleType()))])
    if SCAN_SHARE * nprobe >= clusters and clusters <= MOST_CLUSTERS:  # routing would spare little and repeat the queries
        found = index.centroids.orderBy("cluster").collect()
        centers, ids = np.array([r["center"] for r in found], np.float64), np.array([r["cluster"] for r in found], np.int32)
        near = dealt(asked).mapInArrow(partial(scanned, where, folders, centers, ids, nprobe, k, leave_out, block_bytes), schema)
    else:
        near = routed(asked, index, k, nprobe, leave_out, block_bytes, queries.count(), where, folders, schema)
    merged = near.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))  # nprobe lists of at most k numbers
    found = merged.where(F.size("d") > 0).select("id", (F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")).alias("score"))
    found = materialise(found, "routed")
    unanswered = queries.join(found, "id", "left_anti")
    if unanswered.isEmpty():
        return found
    return found.unionByName(nearest_mean(unanswered, index.rows(), k, leave_out, ["id"]))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows (or all that differ): the first, then again and again the one farthest from those before."""
    square, near, out = norms(x), np.full(len(x), np.inf), [0] if len(x) else []
    while 0 < len(out) < min(n, len(x)):
        near = np.minimum(near, squares(x[out[-1:]], square[out[-1:]], x, square)[0])
        near[out] = 0
        if not near.max() > 0:
            break
        out.append(int(near.argmax()))
    return x[out]


def placed(centers: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with their nearest center and their distance to it; those without a length (NaN, too large) are no one's neighbours."""
    for b in batches:
        if len(b):
            x = vectors(b)
            with np.errstate(over="ignore", invalid="ignore"):
                fine = np.isfinite(norms(x))
            b, x = b[fine], x[fine]  # noqa: PLW2901
            own = nearest_centers(x, centers, np.arange(len(centers), dtype=np.int32), 1)[1][:, 0]
            yield b.assign(cluster=own, far=np.sqrt(((x - centers[own]) ** 2).sum(axis=1)))


def lower_bounds(q: np.ndarray, square: np.ndarray, centers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each region and query what no row is nearer than, with all rounding taken off. low and high: distances to its center that the region's rows have."""
    norm, out = norms(centers), np.empty((len(centers), len(q)), np.float32)
    for i in range(0, len(q), 1024):
        some = slice(i, i + 1024)
        d = squares(q[some], square[some], centers, norm)
        off = 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (square[some, None] + norm[None, :])
        near, far = np.sqrt(np.maximum(d - off, 0)), np.sqrt(np.maximum(d + off, 0))
        bound = np.maximum(near - high, low - far) - 1e-9 * (far + high)
        out[:, some] = np.nextafter(bound.T.astype(np.float32), np.float32(-np.inf))
    return out


def region_block(b: pa.Table) -> dict:
    return prepared(measured({c: b.column(c).to_pandas() for c in ("entry", "grp") if c in b.column_names} | {"vec": matrix(b.column("vec"))}))


def exact_rows(where_path: str, folders: list[str], centers: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, leave_out: str, block_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and score. Queries of one region go over the regions, their own first, then by the least bound; each with those queries whose bound is not above their k nearest so far. batches: cluster, id, entry, grp, vec, ordered by cluster."""
    where, _ = fs.FileSystem.from_uri(where_path)

    def answer(cluster: int, asked: pa.Table) -> pa.RecordBatch:
        q, names = matrix(asked.column("vec")), asked.select(["entry", "grp"]).to_pandas()
        with np.errstate(over="ignore", invalid="ignore"):
            square = norms(q)
        fine, best = np.isfinite(square), np.full((len(q), k), np.inf)
        bounds = lower_bounds(q[fine], square[fine], centers, low, high)
        q1, at = single(-2 * q, 1), np.flatnonzero(fine)
        least = bounds.min(axis=1, initial=np.inf).astype(np.float64)
        least[cluster] = -np.inf
        most = np.full(len(at), np.inf)
        for region in np.argsort(least, kind="stable").tolist() if len(at) else []:
            if max(least[region], 0) ** 2 > most.max():
                break
            which = at[~(np.maximum(bounds[region], 0).astype(np.float64) ** 2 > most)]
            if not len(which):
                continue
            some, near, near_q, near_square, near_q1 = names.iloc[which], best[which], q[which], square[which], q1[which]
            for b in blocks(where, folders, region, block_bytes):
                block = region_block(b)
                keys = left_out(leave_out, some, block)
                for rows, columns in tiles(len(which), len(block["vec"])):
                    nearer(near, near_q, near_square, near_q1, block, keys, rows, columns)
            best[which] = near
            most = best[at].max(axis=1)
            most += 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (3 * square[at] + 2 * most)  # rounding of what was found
        mean, n = means(best, square)
        return pa.RecordBatch.from_arrays([asked.column("id").combine_chunks(), pa.array(mean, mask=n == 0)], ["id", "score"])

    for cluster, asked in by_cluster(batches):
        for i in range(0, asked.num_rows, TOGETHER):
            yield answer(cluster, asked.slice(i, TOGETHER))
    pa.default_memory_pool().release_unused()


def exact_mean(queries: DataFrame, bank: DataFrame, k: int = 5, leave_out: str = "none", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id and score: the mean distance to the k nearest of all rows, as `nearest_mean`. queries: id, vec and, where left out, entry (and grp); bank: entry, row, vec (and grp)."""
    spark, group = queries.sparkSession, F.when(F.col("grp") != "", F.col("grp")) if leave_out == "group" else F.lit(None).cast("string")
    n, width = bank.agg(F.count("*"), F.max(F.size("vec"))).first()
    every = max(1, n // max(1, DRAWN_BYTES // (8 * max(1, width or 1))))
    drawn = bank.where(F.pmod(F.xxhash64("entry", "row", F.lit(SEED)), F.lit(every)) == 0).select("vec").toPandas()  # DRAWN_BYTES, about
    x = vectors(drawn)
    with np.errstate(over="ignore", invalid="ignore"):
        centers = far_apart(x[np.isfinite(norms(x))], n_clusters(n)) if len(x) else x
    if not len(centers):
        return nearest_mean(queries, bank, k, leave_out, ["id"])
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>")
    put = bank.select("entry", "row", "vec", *(["grp"] if leave_out == "group" else []))
    schema = T.StructType([*put.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("far", T.DoubleType())])
    regions = listed(dealt(put).mapInPandas(partial(placed, centers), schema), centroids)
    low, high = np.full(len(centers), np.inf), np.full(len(centers), -np.inf)  # regions without rows are above any bound
    for r in regions.rows().groupBy("cluster").agg(F.min("far").alias("low"), F.max("far").alias("high")).collect():  # a row for each region
        low[r["cluster"]], high[r["cluster"]] = r["low"], r["high"]
    where = regions.root if "://" in regions.root else "file://" + regions.root.removeprefix("file:")
    folders = [f"{fs.FileSystem.from_uri(where)[1]}/{f}" for f in regions.folders]
    asked = dealt(queries.select("id", (F.lit(None).cast("bigint") if leave_out == "none" else F.col("entry")).alias("entry"), group.alias("grp"), "vec"))
    put = parted(assign(asked, centroids), asked, centroids, 1, queries.count(), TOGETHER)
    sorted_ = put.repartition(3 * spark.sparkContext.defaultParallelism, "cluster", "part").sortWithinPartitions("cluster", "part")
    out = T.StructType([queries.schema["id"], T.StructField("score", T.DoubleType())])
    return sorted_.select("cluster", "id", "entry", "grp", "vec").mapInArrow(partial(exact_rows, where, folders, centers, low, high, k, leave_out, block_bytes), out)


def probes_for(queries: DataFrame, index: Lists, k: int = 5, target: float = 0.9, leave_out: str = "none", most: int = 1000, seed: int = SEED) -> int:
    """The smallest of NPROBE, 2 NPROBE, 4 NPROBE, ... with which a share `target` of sampled queries gets the score of the full scan.

    At most `most` queries, by a seeded hash of their ids, are asked; with all clusters probed every score is exact, so the search ends.
    """
    asked = materialise(queries.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most), "asked")
    exact = materialise(nearest_mean(asked, index.rows(), k, leave_out, ["id"]).withColumnRenamed("score", "exact"), "exact")
    clusters, n = index.centroids.count(), NPROBE
    while n < clusters:
        share = recall(searched_mean(asked, index, k, n, leave_out), exact).first()["recall"]
        if share is None or share >= target:
            break
        n *= 2
    return min(n, clusters)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: the share of ids whose score is that of the full scan (id, exact)."""
    both = found.join(exact, "id")
    return both.agg(F.count("*").alias("queries"), F.avg((F.col("score") <= F.col("exact") + 1e-9).cast("double")).alias("recall"))
