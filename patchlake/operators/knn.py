"""Nearest rows of a bank: mean distance to the k nearest, and the nearest of each label.

The bank is written once to the shared folder in blocks of bounded bytes, each
with a bounded number of rows. Queries are dealt out evenly once. Tasks take batches
of them and go over the blocks one after the other, keeping the k smallest distances
so far; so a task holds one block, one batch and a small tile of distances, however many
rows there are; the bank is read once for each batch, and neither side is broadcast or gathered.

Distances are Euclidean, as |q|^2 + |b|^2 - 2qb in double precision. A tile in single
precision tells first which pairs can't be among the nearest, by a bound on its
rounding error; all others are computed in double precision. Rows of the
query's own entry, or of its own non-empty group, can be left out. With fewer
than k rows left the mean is over those; with none it is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.sources.shared import scratch_path

BLOCK_BYTES = 16 << 20
BATCH = 8192
#: Rows of a block that are decoded together.
READ_ROWS = 4096
#: A matrix of distances, of some queries to some rows of a block, has so many bytes at most and, in a scan, so many columns.
TILE_BYTES, WIDE = 2 << 20, 1024
#: Rounding error of a squared distance, as a share of the squared length.
NOISE = 64 * np.finfo(np.float64).eps
#: Squared lengths that single precision may be asked about, and what products too small for it add up to at most.
LARGE, TINY = 1e30, 1e-30
#: Squared weights that single precision may be asked about: up to so much, and down to one over it.
SCALES = 1e15


def write_blocks(bank: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[str, int]:
    """The path and number of blocks. bank: entry, row, vec and, where needed, grp, label, weight."""
    size, rows = bank.agg(F.sum(8 * F.size("vec") + 64), F.count("*")).first()
    n = -(-(size or 0) // block_bytes) or 1
    path = scratch_path(bank.sparkSession, "bank")
    block = F.pmod(F.xxhash64("entry", "row"), F.lit(n))
    bank.withColumn("block", block).repartition(F.col("block")).write.partitionBy("block").parquet(path)
    return path, n if rows else 0


def dealt(queries: DataFrame) -> DataFrame:
    """Queries dealt out evenly: what a search costs is rows, however few bytes and files hold them."""
    return queries.repartition(3 * queries.sparkSession.sparkContext.defaultParallelism)


def vectors(batch: pd.DataFrame) -> np.ndarray:
    return np.array(batch["vec"].tolist(), np.float64)


def read_block(path: str, block: int) -> dict:
    where, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    found = ds.dataset(f"{root}/block={block}", filesystem=where, format="parquet")
    names = [c for c in found.schema.names if c != "vec"]
    vec, at, others = np.empty((found.count_rows(), 0)), 0, []
    for b in found.to_batches(batch_size=READ_ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False):  # no second copy of the whole block
        if b.num_rows:
            part = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            vec = vec if at else np.empty((len(vec), part.shape[1]))
            vec[at : at + len(part)] = part
            at += len(part)
            others.append(b.select(names))
    held = pa.Table.from_batches(others, pa.schema([found.schema.field(c) for c in names]))
    out = {c: held.column(c).to_pandas() for c in names} | {"vec": vec}
    del found, held, others
    pa.default_memory_pool().release_unused()
    return measured(out)


def measured(block: dict) -> dict:
    """The block with squared lengths and, for names of groups, their numbers among the sorted names."""
    block["norm"] = norms(block["vec"])
    if "grp" in block:
        block["names"], block["grp"] = np.unique(block["grp"].fillna("").to_numpy(str), return_inverse=True)
    return block


def norms(x: np.ndarray, step: int = 4096) -> np.ndarray:
    """Squared lengths of rows, some at a time."""
    return np.concatenate([np.zeros(0), *[(x[i : i + step] ** 2).sum(axis=1) for i in range(0, len(x), step)]])


def tiles(rows: int, columns: int) -> Iterator[tuple[slice, slice]]:
    """The matrix of so many rows and columns in parts of at most TILE_BYTES."""
    high = max(1, TILE_BYTES // (8 * max(1, min(WIDE, columns))))
    for i in range(0, rows, high):
        for j in range(0, columns, WIDE):
            yield slice(i, min(i + high, rows)), slice(j, min(j + WIDE, columns))


def left_out(leave_out: str, batch: pd.DataFrame, block: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of own entry and own group, as asked: each query's (-1: not in the block, or none) and each row's. Pairs with one number don't count."""
    if leave_out == "none":
        return []
    codes, entries = pd.factorize(block["entry"], sort=True)
    keys = [(pd.Index(entries).get_indexer(batch["entry"]), codes)]
    if leave_out == "group":
        mine, names = batch["grp"].fillna("").to_numpy(str), block["names"]
        at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
        keys.append((np.where((names[at] == mine) & (mine != ""), at, -1), block["grp"]))
    return keys


def places(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a matrix, in order; faster than of two dimensions at once."""
    return np.divmod(np.flatnonzero(true), max(1, true.shape[1]))


def leave(d: np.ndarray, keys: list[tuple[np.ndarray, np.ndarray]], rows: slice, columns: slice) -> None:
    """Put infinity where a query and a row have one number; only queries within the tile's range of numbers are compared."""
    for mine, theirs in keys:
        own, other = mine[rows], theirs[columns]
        some = np.flatnonzero((own >= max(0, other.min())) & (own <= other.max()))
        at, column = places(own[some, None] == other[None, :])
        d[some[at], column] = np.inf


def squares(q: np.ndarray, square: np.ndarray, vec: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Squared distances, in one matrix of that size; rounding may leave some just below 0."""
    d = (-2 * q) @ vec.T
    d += norm[None, :]
    d += square[:, None]
    return d


def settled(best: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Distances from squared ones. What rounding can't tell from 0 is 0, so that equal rows are 0 apart whatever batch and block they are in."""
    return np.sqrt(np.where(best > NOISE * square[:, None], best, 0))


def distances(q: np.ndarray, square: np.ndarray, vec: np.ndarray, norm: np.ndarray) -> np.ndarray:
    d = squares(q, square, vec, norm)
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


def keep_least(best: np.ndarray, d: np.ndarray) -> None:
    """Put the least of both into `best`, in each row; changes d."""
    k = best.shape[1]
    closer = d < best.max(axis=1)[:, None]
    many = np.count_nonzero(closer, axis=1)
    if many.max(initial=0) <= 8 * k:  # mostly so after the first tiles
        rows = np.flatnonzero(many)
        for i in rows:
            best[i] = np.partition(np.concatenate([best[i], d[i, closer[i]]]), k - 1)[:k]
        return
    if d.shape[1] > k:
        d.partition(k - 1, axis=1)
    best[:] = np.partition(np.concatenate([best, d[:, :k]], axis=1), k - 1, axis=1)[:, :k]


def single(vec: np.ndarray, *last: np.ndarray | float) -> np.ndarray:
    """Vectors in single precision, with more components."""
    width = vec.shape[1]
    out = np.empty((len(vec), width + len(last)), np.float32)
    with np.errstate(over="ignore", invalid="ignore"):  # such rows are compared in double precision
        out[:, :width] = vec
        for i, x in enumerate(last):
            out[:, width + i] = x
    return out


def limits(best: np.ndarray, square: np.ndarray, norm: np.ndarray, width: int) -> np.ndarray:
    """What -2qb + |b|^2 in single precision is at most, for each query, if a row is closer than the k nearest so far.

    Its error is below 2 (width + 4) 2^-24 (|q|^2 + 2 |b|^2), for any order of sums.
    """
    size = square + 2 * norm.max(initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        limit = (best.max(axis=1) - square + 2 * (width + 4) * 2.0**-24 * size + TINY).astype(np.float32)
        return np.where(size < LARGE, np.nextafter(limit, np.float32(np.inf)), np.float32(np.inf))


def put_least(best: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
    """Put the least of both into `best`: d are distances of the rows `at`, which are sorted."""
    rows, own, count = np.unique(at, return_inverse=True, return_counts=True)
    k = best.shape[1]
    wide = np.full((len(rows), k + count.max(initial=0)), np.inf)
    wide[:, :k] = best[rows]
    wide[own, k + np.arange(len(at)) - (np.cumsum(count) - count)[own]] = d
    best[rows] = np.partition(wide, k - 1, axis=1)[:, :k]


def nearer(best: np.ndarray, q: np.ndarray, square: np.ndarray, q1: np.ndarray, block: dict, keys: list[tuple[np.ndarray, np.ndarray]], rows: slice, columns: slice) -> None:
    """Put the least distances of a tile into `best`: those of few pairs one by one, else all."""
    vec, norm, near = block["vec"][columns], block["norm"][columns], best[rows]
    limit = limits(near, square[rows], norm, q.shape[1])
    may = q1[rows] @ block["single"][columns].T <= limit[:, None] if np.isfinite(limit).all() else None
    if may is None or np.count_nonzero(may) > 2 * near.size:  # mostly so in the first tile
        d = squares(q[rows], square[rows], vec, norm)
        leave(d, keys, rows, columns)
        keep_least(near, d)
        return
    some = np.flatnonzero(may.any(axis=1))
    at, column = places(may[some])
    at = some[at]
    for mine, theirs in keys:
        other = (mine[rows][at] < 0) | (mine[rows][at] != theirs[columns][column])
        at, column = at[other], column[other]
    put_least(near, at, ((q[rows][at] - vec[column]) ** 2).sum(axis=1))


def prepared(block: dict) -> dict:
    """A block as `nearer` takes it."""
    block = by_entry(block)
    return block | {"single": single(block["vec"], block["norm"])}


def mean_block(path: str, b: int) -> dict:
    return prepared(read_block(path, b))


def means(best: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean distance and number of the rows found, from squared distances."""
    best = settled(best, square)
    found = np.isfinite(best)
    n = found.sum(axis=1)
    return np.where(found, best, 0).sum(axis=1) / np.maximum(n, 1), n


def mean_rows(path: str, blocks: int, k: int, leave_out: str, keep: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = mean_block(path, 0) if blocks == 1 else None
    for whole in batches:
        for at in range(0, len(whole), BATCH):
            batch = whole.iloc[at : at + BATCH]
            q = vectors(batch)
            square = norms(q)
            q1 = single(-2 * q, 1)
            best = np.full((len(batch), k), np.inf)
            for b in range(blocks):
                block = None  # the last one goes before the next is read
                block = held or mean_block(path, b)
                keys = left_out(leave_out, batch, block)
                for rows, columns in tiles(len(q), len(block["vec"])):
                    nearer(best, q, square, q1, block, keys, rows, columns)
            mean, n = means(best, square)
            yield batch[keep].assign(score=pd.Series(np.where(n > 0, mean, np.nan), index=batch.index).astype("Float64").mask(n == 0))
    del held
    pa.default_memory_pool().release_unused()


def nearest_mean(queries: DataFrame, bank: DataFrame, k: int = 5, leave_out: str = "none", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` columns and score: the mean distance to the k nearest bank rows. leave_out: none, entry or group."""
    keep = [c for c in queries.columns if c != "vec"] if keep is None else keep
    path, blocks = write_blocks(bank.select("entry", "row", "vec", *(["grp"] if leave_out == "group" else [])), block_bytes)
    if not blocks:
        return queries.select(*keep, F.lit(None).cast("double").alias("score"))
    used = list(dict.fromkeys([*keep, *({"entry": ["entry"], "group": ["entry", "grp"]}.get(leave_out, [])), "vec"]))
    schema = T.StructType([queries.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    return dealt(queries.select(*used)).mapInPandas(partial(mean_rows, path, blocks, k, leave_out, keep), schema)


def ordered(block: dict, order: np.ndarray) -> dict:
    return {c: x if c == "names" else x[order] if isinstance(x, np.ndarray) else x.iloc[order].reset_index(drop=True) for c, x in block.items()}


def by_entry(block: dict) -> dict:
    """The block in the order of entries, so that few tiles hold an entry's rows."""
    return ordered(block, np.argsort(pd.factorize(block["entry"], sort=True)[0], kind="stable"))


def by_label(block: dict) -> dict:
    """The block in the order of labels and ids, and where each label's rows lie; without rows that have no distance (NaN, too large, no weight)."""
    order = np.lexsort((block["id"].to_numpy(), codes := pd.factorize(block["label"], use_na_sentinel=False)[0]))
    fine = np.isfinite(block["norm"]) & (block["weight"].notna().to_numpy() if "weight" in block else True)
    order = order[fine[order]]
    out = ordered(block, order)
    ends = np.flatnonzero(np.diff(codes[order], append=-1)) + 1
    return out | {"own": list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(order) else []}


def slack(width: int) -> float:
    """Rounding error of `lower`, as a share of (|q|^2 + 2 |b|^2) / weight^2: twice what inputs, products and sums in any order can make."""
    return 4 * (width + 8) * 2.0**-24


def label_block(path: str, b: int) -> dict:
    """The block by label, with weights; where single precision may be asked about its rows, so that products with `label_queries` are `lower`: at most (distance / weight)^2."""
    block = by_label(read_block(path, b))
    vec, norm = block["vec"], block["norm"]
    weight = block["weight"].to_numpy(np.float64) + 1e-6 if "weight" in block else np.ones(len(vec))
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        inverse = weight**-2.0
        may = (weight > 0) & (inverse > 1 / SCALES) & (inverse < SCALES) & (norm < LARGE) & (norm * inverse < LARGE)
    out = block | {"weight": weight, "inverse": inverse, "single": None}
    if may.all():
        out["single"] = single(vec, norm * inverse * (1 - 2 * slack(vec.shape[1])), inverse)
        out["single"][:, : vec.shape[1]] *= inverse[:, None]
    return out


def label_queries(q: np.ndarray, square: np.ndarray) -> np.ndarray:
    return single(-2 * q, 1, square * (1 - slack(q.shape[1])))


def least_of(low: np.ndarray, near: np.ndarray, q: np.ndarray, square: np.ndarray, block: dict, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries that may have a row as near as `near` among those from start to end, their least distance there and its row, the first of equals. low: `lower`, infinite where left out."""
    vec, norm, weight, inverse = (block[c][start:end] for c in ("vec", "norm", "weight", "inverse"))
    first = low.argmin(axis=1)
    own = low[np.arange(len(low)), first]
    with np.errstate(over="ignore"):
        most = own + 2 * slack(q.shape[1]) * (square + 2 * norm[first]) * inverse[first]  # that row is no farther
        limit = np.nextafter((np.minimum(most, near**2 * (1 + 1e-9)) + 10 * TINY).astype(np.float32), np.float32(np.inf))
    some = np.flatnonzero((own <= limit) & (own < np.inf))
    may = low[some] <= limit[some, None]
    if np.count_nonzero(may) > 4 * len(some):  # many equal rows
        d = distances(q[some], square[some], vec, norm) / weight
        d[~may] = np.inf
        at, column = np.arange(len(some)), d.argmin(axis=1)
    else:
        at, column = places(may)
    d = np.sqrt(((q[some[at]] - vec[column]) ** 2).sum(axis=1)) / weight[column]
    order = np.lexsort((d, at))  # stable: rows of equals stay in order
    order = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
    return some[at[order]], d[order], start + column[order]


def label_tile(best: dict[str, tuple[np.ndarray, np.ndarray]], q: np.ndarray, square: np.ndarray, q1: np.ndarray, block: dict, keys: list[tuple[np.ndarray, np.ndarray]], rows: slice, columns: slice) -> None:
    """Put each label's least distance in a tile, and its id, into `best`; single precision tells first which pairs can't be."""
    labels, ids, weight = block["label"].to_numpy(), block["id"].to_numpy(), block["weight"]
    low = None
    if block["single"] is not None and square[rows].max() * max(1, block["inverse"][columns].max()) < LARGE:
        low = q1[rows] @ block["single"][columns].T
    d = low if low is not None else distances(q[rows], square[rows], block["vec"][columns], block["norm"][columns]) / weight[None, columns]
    leave(d, keys, rows, columns)
    first = int(np.searchsorted(np.array([end for _, end in block["own"]]), columns.start, "right"))
    for start, end in block["own"][first:]:
        if start >= columns.stop:
            break
        start, end = max(start, columns.start), min(end, columns.stop)  # noqa: PLW2901
        if labels[start] not in best:
            best[labels[start]] = np.full(len(q), np.inf), np.full(len(q), np.iinfo(np.int64).max)
        old, place = (x[rows] for x in best[labels[start]])
        part = d[:, start - columns.start : end - columns.start]
        if low is not None:
            at, near, where = least_of(part, old, q[rows], square[rows], block, start, end)
        else:
            at, where = np.arange(len(d)), start + part.argmin(axis=1)
            near = part[at, where - start]
        where = ids[where]  # the smallest id of equals
        closer = (near < old[at]) | ((near == old[at]) & (where < place[at]))
        old[at[closer]], place[at[closer]] = near[closer], where[closer]


def label_rows(path: str, blocks: int, leave_out: str, keep: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = label_block(path, 0) if blocks == 1 else None
    for whole in batches:
        for at in range(0, len(whole), BATCH):
            batch = whole.iloc[at : at + BATCH]
            q = vectors(batch)
            square = norms(q)
            q1 = label_queries(q, square)
            best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for b in range(blocks):
                block = None  # the last one goes before the next is read
                block = held or label_block(path, b)
                keys = left_out(leave_out, batch, block) if block["own"] else []
                for rows, columns in tiles(len(q), len(block["vec"])):
                    label_tile(best, q, square, q1, block, keys, rows, columns)
            for label, (near, where) in best.items():
                found = np.isfinite(near)
                yield batch.loc[found, keep].assign(label=label, distance=near[found], nearest=where[found])
    del held
    pa.default_memory_pool().release_unused()


def label_nearest(queries: DataFrame, bank: DataFrame, leave_out: str = "none", weighted: bool = False, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` columns, label, distance, nearest: for each label its nearest row (bank column id), by weighted distance if asked."""
    keep = [c for c in queries.columns if c != "vec"] if keep is None else keep
    path, blocks = write_blocks(bank.select("entry", "row", "id", "label", "vec", *(["weight"] if weighted else []), *(["grp"] if leave_out == "group" else [])), block_bytes)
    schema = T.StructType([queries.schema[c] for c in keep] + [T.StructField("label", T.StringType()), T.StructField("distance", T.DoubleType()), T.StructField("nearest", T.LongType())])
    if not blocks:
        return queries.sparkSession.createDataFrame([], schema)
    used = list(dict.fromkeys([*keep, *({"entry": ["entry"], "group": ["entry", "grp"]}.get(leave_out, [])), "vec"]))
    return dealt(queries.select(*used)).mapInPandas(partial(label_rows, path, blocks, leave_out, keep), schema)
