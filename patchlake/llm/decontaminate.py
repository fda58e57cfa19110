"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of documents of bounded size. Its words are mapped to the words
of the benchmark; all others become separators, and runs of benchmark words too
short for any window are left out, as no window can lie in them. Over what
remains stand a suffix array (by doubling), its BWT in a wavelet matrix, and
suffix positions sampled at every 16th place and at each run's start. All
windows are searched backwards together, located, and their spans merged.

The benchmark is written to the shared folder in blocks of about `block_bytes` of
text. In one narrow pass each task takes its shards of documents one after the
other, searches the blocks in turn and merges their spans: it holds one shard and
one block, nothing goes through the driver, and documents are never shuffled.

Defined cases: null texts have no words and are clean; an item without words
finds nothing, one of fewer than 13 is one window; a null item_id marks words
but isn't listed; equal items are each listed; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache, partial

import numpy as np
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.llm.common import map_texts, scratch_path

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 2 << 20
SAMPLE = 16
#: Bytes to themselves if they belong to words, A-Z to a-z, others to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class WaveletMatrix:
    """Rank and access over symbols below 2**levels; arguments are arrays."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.ones, self.zeros = [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(len(bits) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.levels = levels

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros_like(place)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][start], self.ones[k][place]
            start, place = np.where(bit, self.zeros[k] + a, start - a), np.where(bit, self.zeros[k] + b, place - b)
        return place - start

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for k in range(self.levels):
            ones = self.ones[k][place]
            bit = self.ones[k][place + 1] > ones
            symbol = symbol * 2 + bit
            place = np.where(bit, self.zeros[k] + ones, place - ones)
        return symbol


class FMIndex:
    """Over runs of symbols from 1 up, each run after a 0; every 0 counts as a symbol of its own."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        n, breaks = len(text), text == 0
        rank = np.where(breaks, np.cumsum(breaks) - 1, int(breaks.sum()) - 1 + text).astype(np.int64)
        span = 1
        while True:
            paired = rank * (int(rank.max()) + 2)
            paired[:-span] += rank[span:] + 1
            order = np.argsort(paired)
            ahead = paired[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
            span *= 2
            if rank[order[-1]] == n - 1 or span >= n:
                break
        bwt = text[order - 1]
        self.tree = WaveletMatrix(bwt, max(1, symbols.bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.tree.levels))])
        self.known = np.where((order % sample == 0) | (bwt == 0) | breaks[order], order, -1)
        self.size = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns are rows, short ones led by -1. The rows found, with their intervals of suffixes."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, k]
            on = symbol >= 0
            put = symbol[on]
            lo[on] = self.before[put] + self.tree.rank(put, lo[on])
            hi[on] = self.before[put] + self.tree.rank(put, hi[on])
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walked back to the next sampled one."""
        at, steps = self.known[rows], np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(at < 0)
        rows = rows[open_]
        while len(open_):
            symbol = self.tree.access(rows)
            rows = self.before[symbol] + self.tree.rank(symbol, rows)
            steps[open_] += 1
            found = self.known[rows]
            done = found >= 0
            at[open_[done]] = found[done] + steps[open_[done]]
            open_, rows = open_[~done], rows[~done]
        return at


class Benchmark:
    """One block of items: the words, and the distinct windows with the items they belong to."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        self.code: dict[bytes, int] = {}
        owners: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            words = [self.code.setdefault(w, len(self.code) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                owners[tuple(words[i : i + WINDOW])].add(item)
        self.owners = list(owners.values())
        self.length = np.array([len(w) for w in owners], np.int64)
        self.windows = np.array([(-1,) * (WINDOW - len(w)) + w for w in owners], np.int64).reshape(-1, WINDOW)


def find(benchmark: Benchmark, texts: list[str | None]) -> tuple[np.ndarray, list[list], list[set]]:
    """For each text its number of words, its merged spans of hit words, and its items."""
    get = benchmark.code.get
    coded = [[get(w, 0) for w in words_of(t)] for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a separator stands after each text
    codes = np.fromiter((x for c in coded for x in (*c, 0)), np.int64, int(sizes.sum()) + len(sizes))
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if not len(benchmark.windows):
        return sizes, spans, items
    edge = np.diff(np.concatenate([[0], codes > 0, [0]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= benchmark.length.min()
    first, last = first[long], last[long]
    if not len(first):
        return sizes, spans, items
    lengths = last - first + 1  # with the separator after the run
    origin = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    index = FMIndex(np.concatenate([[0], codes[origin]]), len(benchmark.code))
    which, lo, hi = index.search(benchmark.windows)
    if not len(which):
        return sizes, spans, items
    count = hi - lo
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    which = np.repeat(which, count)
    word = origin[index.locate(rows) - 1]
    text = np.searchsorted(starts, word, side="right") - 1
    for w, t in np.unique(np.stack([which, text]), axis=1).T:
        items[t] |= benchmark.owners[w]
    order = np.argsort(word, kind="stable")
    for t, a, n in zip(text[order].tolist(), (word - starts[text])[order].tolist(), benchmark.length[which][order].tolist(), strict=True):
        if spans[t] and a <= spans[t][-1][1]:
            spans[t][-1][1] = max(spans[t][-1][1], a + n)
        else:
            spans[t].append([a, a + n])
    return sizes, spans, items


@lru_cache(maxsize=1)
def block_of(path: str, block: int) -> Benchmark:
    where, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    folder = f"{root}/block={block}"
    if where.get_file_info(folder).type == fs.FileType.NotFound:
        return Benchmark([])
    rows = ds.dataset(folder, filesystem=where, format="parquet").to_table(columns=["item", "text"])
    return Benchmark(sorted(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True), key=repr))


def merged(spans: list[list]) -> list[list]:
    """Sorted, joined where they touch or overlap."""
    out: list[list] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def worker(path: str, blocks: int):
    def work(texts: list) -> list:
        sizes, spans, items = find(block_of(path, 0), texts)
        for k in range(1, blocks):
            _, more, also = find(block_of(path, k), texts)
            spans = [merged(x + y) if y else x for x, y in zip(spans, more, strict=True)]
            items = [x | y for x, y in zip(items, also, strict=True)]
        told = [[{"first": a, "last": b} for a, b in s] for s in spans]
        return [sizes, [sum(b - a for a, b in s) for s in spans], told, [sorted(x for x in i if x is not None) for i in items]]

    return work


def write_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[str, int]:
    """The benchmark's items in the shared folder, in blocks of about so many bytes, dealt by a hash of the text; path and number of blocks."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    path = scratch_path(benchmark.sparkSession, "benchmark")
    block = F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    dealt = benchmark.select(F.col("item_id").cast("string").alias("item"), "text", block.alias("block"))
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    return path, n


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "found", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` columns and a struct: n_words, n_hit, spans of hit words (first, one past last), items, contaminated."""
    path, blocks = write_blocks(benchmark, block_bytes)
    out = map_texts(docs, partial(worker, path, blocks), FOUND, text, keep, into, SHARD_BYTES)
    name = out.columns[-1]
    hit, words = F.col(f"`{name}`.n_hit"), F.col(f"`{name}`.n_words")
    return out.withColumn(name, F.col(f"`{name}`").withField("contaminated", (hit > 0) & (20 * hit >= words)))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def without_spans(text: str, spans: list) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-@\[-\x60\x7B-\x7F]+", text)]
    left, end = [], 0
    for s in spans:
        left.append(text[end : at[s["first"]][0]])
        end = at[s["last"] - 1][1]
    return "".join([*left, text[end:]])
