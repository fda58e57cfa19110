"""Cluster-routed search and quantised vectors.

Clusters are a table of centroids (cluster, center) and the bank with its cluster
column. `patchlake.operators.lists` keeps and searches the rows by cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.operators.knn import norms, read_block, squares, vectors, write_blocks

LEAST_ROWS, GROWTH, ROUNDS, NPROBE = 20_000, 1.5, 25, 8
MOST_CLUSTERS, LEAST_CLUSTERS, ROWS_PER_CLUSTER = 1024, 16, 64
SEED = 42
#: Rows that a task gives out together.
SENT_ROWS = 8192
#: A matrix of distances to all rows of a block has so many bytes at most.
TILE_BYTES = 8 << 20


def n_clusters(rows: int) -> int:
    return min(MOST_CLUSTERS, max(LEAST_CLUSTERS, rows // ROWS_PER_CLUSTER))


def needs_rebuild(rows: int, built_rows: int) -> bool:
    return rows > GROWTH * built_rows


def first_columns(d: np.ndarray, n: int) -> np.ndarray:
    """The columns of the n least values of each row, in order; of equal ones the first."""
    if n == 1:
        return d.argmin(axis=1)[:, None]
    if n >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    inside = d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n]
    even = inside.sum(axis=1) == n
    out = np.empty((len(d), n), np.int64)
    at = np.nonzero(inside[even])[1].reshape(-1, n)
    out[even] = np.take_along_axis(at, np.argsort(np.take_along_axis(d[even], at, 1), axis=1, kind="stable"), 1)
    out[~even] = np.argsort(d[~even], axis=1, kind="stable")[:, :n]  # equals at the border, or no numbers
    return out


def nearest_centers(q: np.ndarray, centers: np.ndarray, ids: np.ndarray, n: int, tile_bytes: int = TILE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances (to 12 digits) and ids of the n nearest centers of each row, ties to the smaller id. ids ascend."""
    square, norm, step = norms(q), norms(centers), max(1, tile_bytes // (8 * max(1, len(centers))))
    best, which = np.empty((len(q), min(n, len(ids)))), np.empty((len(q), min(n, len(ids))), ids.dtype)
    for i in range(0, len(q), step):
        d = squares(q[i : i + step], square[i : i + step], centers, norm)
        np.round(d, 12, out=d)
        at = first_columns(d, n)
        best[i : i + step], which[i : i + step] = np.take_along_axis(d, at, 1), ids[at]
    return best, which


def repeated(b: pd.DataFrame, which: np.ndarray, keep: list[str]) -> Iterator[pd.DataFrame]:
    """Each row with each of its clusters, SENT_ROWS at a time: with many probes a batch of rows is many."""
    n = which.shape[1]
    step = max(1, SENT_ROWS // max(1, n))
    for i in range(0, len(b), step):
        own, some = b.iloc[i : i + step], which[i : i + step]
        out = own.loc[own.index.repeat(n), keep].reset_index(drop=True)
        yield out.assign(cluster=some.ravel(), probe=np.tile(np.arange(n), len(some)))


def ranked_centers(centers: np.ndarray, ids: np.ndarray, n: int, keep: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            b = b.reset_index(drop=True)
            yield from repeated(b, nearest_centers(vectors(b), centers, ids, n)[1], keep)


def ranked_blocks(path: str, blocks: int, n: int, keep: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As ranked_centers, with the centers in blocks and the n best so far kept."""
    for b in batches:
        if not len(b):
            continue
        b = b.reset_index(drop=True)
        q = vectors(b)
        best, which = np.empty((len(q), 0)), np.empty((len(q), 0), np.int32)
        for i in range(blocks):
            held = read_block(path, i)
            order = np.argsort(ids := held["entry"].to_numpy(), kind="stable")
            d, near = nearest_centers(q, held["vec"][order], ids[order], n)
            best, which = np.concatenate([best, d], axis=1), np.concatenate([which, near], axis=1)
            order = np.lexsort((which, best), axis=1)[:, :n]
            best, which = np.take_along_axis(best, order, 1), np.take_along_axis(which, order, 1)
        yield from repeated(b, which, keep)


def probes(rows: DataFrame, centroids: DataFrame, n: int = 1, keep: list[str] | None = None, most: int = MOST_CLUSTERS) -> DataFrame:
    """`keep` columns, cluster, probe: the n nearest clusters of each row, ties to the smaller cluster. Up to `most` centroids are sent to tasks; more are read there in blocks."""
    found = centroids.orderBy("cluster").limit(most + 1).collect()
    keep = list(rows.columns) if keep is None else keep
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("cluster", T.IntegerType()), T.StructField("probe", T.IntegerType())])
    put = rows.select(*dict.fromkeys([*keep, "vec"]))
    if len(found) > most:
        path, blocks = write_blocks(centroids.select(F.col("cluster").alias("entry"), F.lit(0).alias("row"), F.col("center").alias("vec")))
        return put.mapInPandas(partial(ranked_blocks, path, blocks, n, keep), schema)
    centers, ids = np.array([r["center"] for r in found], np.float64), np.array([r["cluster"] for r in found], np.int32)
    return put.mapInPandas(partial(ranked_centers, centers, ids, n, keep), schema)


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """The rows with their nearest cluster."""
    return probes(rows, centroids).drop("probe")


def partial_sums(keep: None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, tuple[np.ndarray, int]] = {}
    for b in batches:
        for c, own in b.groupby("cluster"):
            x = np.array(own["vec"].tolist(), np.float64)
            s, n = sums.get(c, (0.0, 0))
            sums[c] = s + x.sum(axis=0), n + len(x)
    if sums:
        yield pd.DataFrame([(c, list(s), n) for c, (s, n) in sums.items()], columns=["cluster", "sums", "n"])


def cluster_sums(centers: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """cluster, sums, n of the rows nearest to each center."""
    sums, n = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
    for b in batches:
        if len(b):
            x = vectors(b)
            own = nearest_centers(x, centers, np.arange(len(centers)), 1)[1][:, 0]
            order = np.argsort(own, kind="stable")
            found, start = np.unique(own[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], start, axis=0)
            n += np.bincount(own, minlength=len(n))
    at = np.flatnonzero(n)
    yield pd.DataFrame({"cluster": at.astype(np.int32), "sums": list(sums[at]), "n": n[at]})


def build(rows: DataFrame, k: int | None = None, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """cluster, center after Lloyd rounds from k rows in the order of a seeded hash; an empty cluster keeps its center. rows: entry, row, vec."""
    spark = rows.sparkSession
    k = n_clusters(rows.count()) if k is None else k
    first = rows.orderBy(F.xxhash64("entry", "row", F.lit(seed)), "entry", "row").limit(k).select("vec").collect()
    centers = np.array([r["vec"] for r in first], np.float64)
    frame = lambda: spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>")
    for _ in range(rounds):
        schema = "cluster int, sums array<double>, n bigint"
        parts = rows.select("vec").mapInPandas(partial(cluster_sums, centers), schema) if len(centers) <= MOST_CLUSTERS else assign(rows.select("vec"), frame()).mapInPandas(partial(partial_sums, None), schema)
        summed = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        moved = summed.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("v")))).alias("c")).collect()  # at most k rows
        new = centers.copy()
        for r in moved:
            new[r["cluster"]] = [x["v"] for x in r["c"]]
        still = np.abs(new - centers).max() == 0
        centers = new
        if still:
            break
    return frame()


def dimension_scales(rows: DataFrame) -> DataFrame:
    """i, scale of each dimension: its largest absolute value over 127, 1 where all are 0."""
    top = rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.max(F.abs("x")).alias("m"))
    return top.select("i", F.when(F.col("m") > 0, F.col("m") / 127).otherwise(F.lit(1.0)).alias("scale"))


def scale_vector(scales: DataFrame) -> DataFrame:
    """One row: scale, in order of the dimensions."""
    return scales.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "scale"))), lambda x: x["scale"]).alias("scale"))
