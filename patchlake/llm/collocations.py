"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces
into words. Nodes are sequences of four words and edges of five (`LONGEST`): each
place of a piece gives the edge that starts there or, near the piece's end, the
shorter tail. So an edge's weight is its phrase's count, and the count of every
shorter phrase is its flow: the counts of what is one word longer and starts with it,
and as a correction the tails that are the phrase itself.

Nodes through which all flow comes by one edge and leaves by one are unary, and
paths through them are compacted into passages (`passages`): each edge points at the
one before it and pointers are doubled, so that a path of n edges takes log2(n)
joins. Candidates of five words are read from passages, and a node inside a
passage is dropped, as its flow is its edges'.

Only phrases with `least` occurrences are asked for, and then all their parts have as
many. So pieces may be cut, without changing any count that is asked for, at words
and between pairs of words that have fewer: words are counted first, then pairs of
frequent words by hash. What is frequent goes to tasks as a filter of `FILTER_BITS`
bits whatever its number; a filter that is wrong about a word or pair only
leaves it in. With far more frequent pairs than bits, pieces are cut less and the
graph has up to one row for each word of the corpus.

Everything is by language. Defined cases: null texts are empty, null languages `und`;
repeated rows count as often; equal scores go by count, then by phrase; texts without
words and empty tables give nothing; words of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.common import dealt_by_bytes, materialise, sent, small_batches

LONGEST, LEAST, TOP = 5, 100, 2000
#: A filter of 8 MB; two bits for each frequent word or pair.
FILTER_BITS = 26
#: Distinct words, or pairs, that a task has in memory before it gives out what it counted.
WORDS_HELD, PAIRS_HELD = 400_000, 3_000_000
#: Salts of the first of two top-k steps.
SALTS = 256
UND = "und"
#: Marks a piece's end; no byte of UTF-8.
END = b"\xff"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str) -> list[bytes]:
    """Lower-case words, with END between pieces."""
    return text.encode().translate(TABLE).replace(END, b" \xff ").split(b" ")


class Vocabulary(dict):
    """Numbers of words in order of appearance; 0 is the piece's end."""

    def __init__(self, lang: str) -> None:
        super().__init__({END: 0, b"": 1})  # two spaces in a row leave nothing between them
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes, self.words = np.zeros(2, np.uint64), [END, b""]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.words.append(word)
        return n

    def ids(self, texts: list[str]) -> np.ndarray:
        """The words' numbers, with 0 between pieces and texts."""
        get, out = self.__getitem__, []
        for t in texts:
            found = np.fromiter(map(get, words_of(t)), np.int32)
            out += [found[found != 1], np.zeros(1, np.int32)]
        return np.concatenate(out)

    def hashed(self) -> np.ndarray:
        """A 64-bit hash of the language and each word."""
        done = len(self.hashes)
        if done < len(self):
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(w, self.seed) for w in self.words[done:]], np.uint64)])
        return self.hashes


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = (first * MIX[0]) ^ ((second >> np.uint64(31)) | (second << np.uint64(33)))
    return (out ^ (out >> np.uint64(29))) * MIX[1]


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of about a megabyte at a time, by language. Batches: text, lang."""
    for b in dealt_by_bytes(batches, 1 << 20):
        for lang in pc.unique(b.column(1)).to_pylist():
            yield lang, b.column(0).filter(pc.equal(b.column(1), lang)).to_pylist()


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, hash, n."""
    held: dict[str, tuple[Vocabulary, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        words, n = held.pop(lang)
        n = np.concatenate([n, np.zeros(len(words) - len(n), np.int64)])[2:]
        strings = pa.array(words.words[2:], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), strings, pa.array(words.hashed()[2:].view(np.int64)), pa.array(n)], ["lang", "word", "hash", "n"])

    for lang, texts in by_language(batches):
        words, n = held.get(lang) or (Vocabulary(lang), np.zeros(0, np.int64))
        now = np.bincount(words.ids(texts), minlength=len(n))  # a batch may have early words only
        now[: len(n)] += n
        held[lang] = words, now
        if len(words) > WORDS_HELD:
            yield out(lang)
    for lang in list(held):
        yield out(lang)


class Filter:
    """What may be frequent: two bits for each hash."""

    def __init__(self, cells: np.ndarray, bits: int) -> None:
        self.cells, self.mask = cells, np.uint64((1 << bits) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for x in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            out &= (self.cells[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) != 0
        return out


def filter_of(hashes: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of a column `hash`; the driver gets its cells, at most 2^(bits - 6) numbers."""
    mask = (1 << bits) - 1
    places = F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))
    cells = hashes.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    found = cells.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("cell").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return Filter(out, bits)


def frequent_ids(words: Vocabulary, texts: list[str], may: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Words' numbers with 0 in place of rare ones, and all words' hashes."""
    ids, hashes = words.ids(texts), words.hashed()
    ok = may(hashes)
    ok[0] = False
    return np.where(ok[ids], ids, 0), hashes


def counted_pairs(filters, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, n of pairs of frequent words; some pairs in several rows."""
    may, held, size = filters.value[0], [], 0
    vocabularies: dict[str, Vocabulary] = {}

    def out() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    for lang, texts in by_language(batches):
        words = vocabularies.setdefault(lang, Vocabulary(lang))
        ids, hashes = frequent_ids(words, texts, may)
        at = np.flatnonzero((ids[1:] != 0) & (ids[:-1] != 0))
        held.append(pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]))
        size += len(at)
        if len(words) > WORDS_HELD:
            del vocabularies[lang]
        if size > PAIRS_HELD:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def grams_of(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """The longest gram at each place of each run (numbers between zeros), by number of words: k, and rows of k numbers."""
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    at = np.flatnonzero(ids)
    grams = np.stack([padded[at + k] for k in range(longest)], axis=1)
    length = np.logical_and.accumulate(grams != 0, axis=1).sum(axis=1)
    for k in range(2, longest + 1):
        yield k, grams[length == k, :k]


def counted_grams(filters, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram (words and spaces), k (number of words), n: edges, and tails of two words or more, each place by itself."""
    may, may_pair = filters.value
    vocabularies: dict[str, Vocabulary] = {}
    for lang, texts in by_language(batches):
        words = vocabularies.setdefault(lang, Vocabulary(lang))
        ids, hashes = frequent_ids(words, texts, may)
        at = np.flatnonzero((ids[1:] != 0) & (ids[:-1] != 0))
        joined = np.zeros(len(ids), bool)  # whether a word goes on from the one before
        joined[at + 1] = may_pair(pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]))
        ids = np.insert(ids, np.flatnonzero(~joined & (ids != 0)), 0)  # a zero where a pair is rare
        strings = pa.array(words.words, pa.binary())
        for k, grams in grams_of(ids, longest):
            text = pc.binary_join_element_wise(*[strings.take(pa.array(grams[:, j])) for j in range(k)], pa.scalar(b" ", pa.binary())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), text, pa.array(np.full(len(text), k, np.int32)), pa.array(np.ones(len(text), np.int64))], ["lang", "gram", "k", "n"])
        if len(words) > WORDS_HELD:
            del vocabularies[lang]


def first_words(gram: str, k: int):
    return F.substring_index(gram, " ", k)


def last_words(gram: str, k: int):
    return F.substring_index(gram, " ", -k)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, hash, n; written. texts: text, lang."""
    counted = texts.mapInArrow(counted_words, "lang string, word string, hash bigint, n bigint")
    return materialise(counted.groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n")), "words")


def graph(texts: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """lang, gram, k, n: edges (k = longest) and tails, without what rare words and pairs cut off; written."""
    context = texts.sparkSession.sparkContext
    may = filter_of(words.where(F.col("n") >= least), bits)
    first = context.broadcast((may,))
    pairs = texts.mapInArrow(partial(counted_pairs, first), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    both = context.broadcast((may, filter_of(pairs, bits)))
    grams = texts.mapInArrow(partial(counted_grams, both, longest), "lang string, gram string, k int, n bigint")
    return materialise(grams.groupBy("lang", "gram", "k").agg(F.sum("n").alias("n")), "grams")


def flows(grams: DataFrame, longest: int = LONGEST) -> dict[int, DataFrame]:
    """lang, gram, n of the phrases of 2 to `longest` words that start anywhere in the graph, by number of words; shorter ones are sums of longer ones and tails."""
    out = {longest: grams.where(F.col("k") == longest).select("lang", "gram", "n")}
    for k in range(longest - 1, 1, -1):
        through = out[k + 1].select("lang", first_words("gram", k).alias("gram"), "n")
        ends = grams.where(F.col("k") == k).select("lang", "gram", "n")
        out[k] = materialise(through.unionByName(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"flow{k}")
    return out


def passages(edges: DataFrame, nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, passage (words and spaces), edges (how many), n: unary paths of the edges, compacted. nodes: lang, gram, n (all flow through it)."""
    node = nodes.select("lang", F.col("gram").alias("node"), "n")
    # an edge with all of a node's flow is the only one on that side
    into = edges.select("lang", "n", last_words("gram", longest - 1).alias("node"), F.col("gram").alias("before")).join(node, ["lang", "node", "n"])
    out_of = edges.select("lang", "n", first_words("gram", longest - 1).alias("node"), "gram")
    before = into.join(out_of, ["lang", "node", "n"]).select("lang", "gram", "before")
    path = edges.join(before, ["lang", "gram"], "left")
    path = materialise(path.select("lang", "gram", "n", F.coalesce("before", "gram").alias("head"), F.col("before").isNotNull().cast("int").alias("steps")), "path")
    while True:
        at = path.select("lang", F.col("gram").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more")).where("more > 0")
        if not at.join(path.select("lang", "head").where("steps > 0").distinct(), ["lang", "head"], "left_semi").limit(1).count():
            break
        path = path.join(at, ["lang", "head"], "left").select("lang", "gram", "n", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        path = materialise(path, "path")
    whole = path.groupBy("lang", "head", "n").agg(F.array_sort(F.collect_list(F.struct("steps", last_words("gram", 1).alias("word")))).alias("words"))  # a path is part of a text at least
    rest = F.expr("transform(slice(words, 2, size(words)), x -> x.word)")
    return whole.select("lang", F.concat_ws(" ", F.array("head"), rest).alias("passage"), F.size("words").alias("edges"), "n")


def windows(paths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, gram, n: the edges of compacted paths."""
    split = paths.select("lang", "n", F.split("passage", " ", -1).alias("w"))
    places = F.sequence(F.lit(1), F.size("w") - (longest - 1))
    return split.select("lang", "n", "w", F.explode(places).alias("i")).select("lang", F.concat_ws(" ", F.slice("w", F.col("i"), longest)).alias("gram"), "n")


def not_absorbed(shorter: DataFrame, longer: DataFrame, k: int) -> DataFrame:
    """Phrases of k words that aren't part of one with k + 1 words and as many occurrences."""
    parts = reduce(DataFrame.unionByName, [longer.select("lang", f("gram", k).alias("gram"), "n") for f in (first_words, last_words)])
    return shorter.join(parts.distinct(), ["lang", "gram", "n"], "left_anti")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, words, a (its count), l, r (its parts' at the cut), n (all words), score: phrases of 2 to `longest` words with `least` occurrences, without those absorbed by longer ones."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UND)).alias("lang"))
    words = word_counts(texts)
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    flow = flows(graph(texts, words, least, longest, bits), longest)
    often = {k: f.where(F.col("n") >= least) for k, f in flow.items()}
    paths = materialise(passages(often[longest], often[longest - 1], longest), "passages")
    often[longest] = materialise(windows(paths, longest), "edges")
    phrases = [often[longest]] + [not_absorbed(often[k], often[k + 1], k) for k in range(longest - 1, 1, -1)]
    lengths = range(longest, 1, -1)
    found = materialise(reduce(DataFrame.unionByName, [p.select("lang", "gram", F.lit(k).alias("k"), F.col("n").alias("a")) for k, p in zip(lengths, phrases, strict=True)]), "phrases")
    counts = reduce(DataFrame.unionByName, [words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), "n"), *[often[k].select("lang", F.col("gram").alias("part"), "n") for k in range(2, longest)]])
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = F.array(F.expr("substring_index(gram, ' ', cut)"), F.expr("substring_index(gram, ' ', cut - k)"))
    sides = cuts.select("lang", "gram", "k", "a", "cut", F.posexplode(sides).alias("side", "part"))
    joined = sides.join(counts, ["lang", "part"]).groupBy("lang", "gram", "k", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    scored = joined.join(sent(totals), "lang").withColumn("score", F.expr("cast(1000 as decimal(20, 0)) * a * total div (cast(l as decimal(20, 0)) * r)"))
    least_cut = scored.groupBy("lang", "gram", "k", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return least_cut.select("lang", F.col("gram").alias("phrase"), F.col("k").alias("words"), "a", "x.l", "x.r", F.col("total").alias("n"), "x.score")


def ranked(found: DataFrame, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """The first `top` of each language and their rank: by score, count and phrase. Each of `salts` parts of a language is cut to its first `top` before."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
