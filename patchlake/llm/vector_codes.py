"""Vector code compression: codebooks for each part of a vector, searched by sliced bit masks.

Components become integers (floor of `scale` times each) and vectors are cut into
equal consecutive parts. A part position's codebook starts as that part of the
vectors with the smallest keys. Each round assigns every part to the nearest entry and
moves entries to the floor of their parts' means. Distances are squared, exact and in
integers; ties go to the lower entry.

The nearest entry is found by slices: for each dimension the entries' coordinates are
sorted, and each prefix of that order has a mask of its entries (64 to a word). A
radius gives one range for each dimension, two masks differ by the entries in it, and
all dimensions' differences ANDed leave the entries within the box. If the nearest of
these is within the radius it's the nearest of all; otherwise its distance, or twice
the radius if the box is empty, is the next radius. So the answer is exact for any
first radius; it is the median distance of entries to their nearest other entry.

Vectors stay where they are read: a round's sums are added up in each task and by
codebook entry in Spark, and what comes to the driver is entries times dimensions
numbers, whatever the number of rows.

Defined cases: null vectors and those with null or non-finite components are dropped;
vectors shorter than the longest, or whose length the parts don't divide, are filled
up with zeros; components beyond `LIMIT` are cut there, so that sums stay in 64 bits;
null keys come last when entries are chosen, equal keys go by vector; with fewer rows
than entries the codebook has as many entries as rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.common import fresh, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Of components, in integers; beyond it (32,768 as given) they are cut.
LIMIT = 1 << 25
#: Rows whose masks and candidates are in memory at once.
STEP = 1024
SUMS = "part int, entry int, n bigint, total array<bigint>"


class Slices:
    """Sorted coordinates of a codebook (entries by dimensions) and the masks of their prefixes."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book.astype(np.int64)
        k, d = self.book.shape
        order = np.argsort(self.book, axis=0, kind="stable")
        self.coordinates = np.take_along_axis(self.book, order, axis=0).T.copy()
        own = np.zeros((k, -(-k // 64)), np.uint64)
        own[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.prefix = np.zeros((d, k + 1, own.shape[1]), np.uint64)
        np.bitwise_or.accumulate(own[order.T], axis=1, out=self.prefix[:, 1:])
        apart = ((self.book[:, None] - self.book[None]) ** 2).sum(axis=2)
        apart[np.arange(k), np.arange(k)] = np.iinfo(np.int64).max
        self.radius = int(np.sqrt(np.median(apart.min(axis=1)))) + 1 if k > 1 else 1

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and entries, ordered by both, of which no coordinate is further away than the row's radius."""
        mask = np.full((len(x), self.prefix.shape[2]), ~np.uint64(0))
        for j, sorted_ in enumerate(self.coordinates):
            first, last = np.searchsorted(sorted_, x[:, j] - radius, "left"), np.searchsorted(sorted_, x[:, j] + radius, "right")
            mask &= self.prefix[j][last] ^ self.prefix[j][first]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance."""
        code, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for begin in range(0, len(x), STEP):
            left = np.arange(begin, min(begin + STEP, len(x)))
            radius = np.full(len(left), self.radius, np.int64)
            while len(left):
                row, entry = self.within(x[left], radius)
                apart = ((x[left[row]] - self.book[entry]) ** 2).sum(axis=1)
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                some = row[starts]  # rows with an entry in the box
                least = np.minimum.reduceat(apart, starts) if len(starts) else apart
                hit = np.flatnonzero(apart == np.repeat(least, np.diff(np.append(starts, len(row)))))
                first = hit[np.unique(row[hit], return_index=True)[1]]  # the lowest of equally near ones
                done = least <= radius[some] ** 2
                code[left[some[done]]], distance[left[some[done]]] = entry[first[done]], least[done]
                wider = radius * 2
                wider[some] = np.sqrt(least.astype(np.float64)).astype(np.int64) + 1
                still = np.ones(len(left), bool)
                still[some[done]] = False
                left, radius = left[still], wider[still]
        return code, distance


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the kept vectors' integers, and which rows are kept."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.slice(ends[0], ends[-1] - ends[0])
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = ends - ends[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept = (bad[ends[1:]] == bad[ends[:-1]]) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    length = np.diff(ends) * kept
    rows = np.repeat(np.arange(len(kept)), length)
    column = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((len(kept), width), np.int64)
    out[rows, column] = np.clip(np.floor(values[np.repeat(ends[:-1], length) + column] * scale), -LIMIT, LIMIT)
    return out[kept], kept


def sums_of(books: np.ndarray, scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's number of parts and their sum for each entry of each position."""
    parts, k, d = books.shape
    slices = [Slices(b) for b in books]
    n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
    for batch in batches:
        x, _ = whole_numbers(batch.column(0), parts * d, scale)
        for p, s in enumerate(slices):
            own = x[:, p * d : (p + 1) * d]
            code, _ = s.nearest(own)
            n[p] += np.bincount(code, minlength=k)
            np.add.at(total[p], code, own)
    part, entry = np.nonzero(n)
    rows = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(rows, ["part", "entry", "n", "total"])


def codes_of(books: np.ndarray, scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept rows with an entry for each part, and the squared distances added up."""
    parts, _, d = books.shape
    slices = [Slices(b) for b in books]
    for batch in batches:
        x, kept = whole_numbers(batch.column(0), parts * d, scale)
        found = [s.nearest(x[:, p * d : (p + 1) * d]) for p, s in enumerate(slices)]
        codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
        error = np.sum([e for _, e in found], axis=0).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * parts, pa.int32()), pa.array(codes.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(kept)), lists, pa.array(error)], ["kept", "codes", "error"])


def usable(vector: str) -> F.Column:
    """Whether a vector is there and all its components are finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    return F.col(f"`{vector}`").isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def codebooks(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Entries by part, entry and position; None if no vector is kept."""
    small_batches(vectors.sparkSession)
    kept = vectors.where(usable(vector)).select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    length = kept.agg(F.max(F.size("v"))).first()[0]
    if length is None:
        return None
    width = -(-max(length, 1) // parts) * parts
    first = kept.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()  # `entries` rows
    start, _ = whole_numbers(pa.array([r.v for r in first], pa.list_(pa.float64())), width, scale)
    books = np.stack(np.split(start, parts, axis=1))
    source = vectors.select(F.col(f"`{vector}`").alias("vector"))
    for _ in range(rounds):
        sums = source.mapInArrow(partial(sums_of, books, scale), SUMS)
        by_entry = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        moved = by_entry.toArrow()  # parts x entries x dimensions rows
        part, entry, at, n, x = (moved.column(c).to_numpy() for c in ("part", "entry", "at", "n", "x"))
        books = books.copy()
        books[part, entry, at] = x // n
    return books


def compress(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", keep: list[str] | None = None, scale: int = SCALE) -> DataFrame:
    """`keep` columns (all by default) of the kept vectors, codes (an entry for each part) and error (squared distance)."""
    small_batches(vectors.sparkSession)
    keep = list(vectors.columns if keep is None else keep)
    put = vectors.select(F.col(f"`{vector}`").alias("vector"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    schema = put.select("kept", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("bigint").alias("error")).schema
    out = put.mapInArrow(partial(codes_of, books, scale), schema)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], F.col("codes").alias(fresh("codes", keep)), F.col("error").alias(fresh("error", keep)))


def restored(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The integer vectors that codes (rows by parts) stand for."""
    return np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1)


def books_digest(books: np.ndarray | None) -> str:
    numbers = "" if books is None else ",".join(map(str, books.reshape(-1).tolist()))
    return hashlib.sha256(numbers.encode()).hexdigest()
