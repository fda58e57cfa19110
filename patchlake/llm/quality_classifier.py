"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on the whole texts of the trusted documents (label quality
1), but for every `HELD_OUT`-th, whose perplexities give the thresholds: a model
knows what it was trained on too well. A text is read as characters; white space
counts once, and a word that repeats the one before it is read as one mark of
repetition, so that texts of repeated words are as improbable as they should be:
a mark is read after a context of its own, in which every other character counts
as one event of no repetition (without this, 26 % of the low-quality documents of
sf0.1 are kept instead of 1 %).
Characters are folded to 12 bits (code points below 0x600 as they are, others by
their remainder, about eight CJK characters to a code), so an n-gram of 5 is one
60-bit number.

Texts are read twice, where they are while the trusted ids are few enough to be sent
(`SENT_IDS`; else both are dealt out by id). The first pass writes the distinct
5-grams of each partition, with their counts in the texts trained on. From these
come, by Spark aggregations, the counts of all orders (5-grams by count, lower
orders by how many characters precede them), discounts from the counts of counts,
and probabilities by joins of each order with its context's sums and with the
next lower order. All distinct 5-grams then meet the model in shards of about
`SHARD_ROWS` rows, by the two characters before the predicted one, and what comes
out is joined with the distinct 5-grams of each partition. In the second pass a
task reads its own partition's log-probabilities, so it holds those of one
partition's 5-grams, however large the model grows. If a text has moved to another
partition in between, its 5-grams are looked up in the shards.

A document is rejected if its perplexity is above `slack` times the `upper`
quantile of held-out documents of its language, or below the `lower` quantile over
`lower_slack` of trusted ones, among which are as many that were trained on, as copies
of these must stay. The means of short texts stray more: their bounds are wider,
and their perplexities count for less in the quantiles.

Defined cases: null and blank texts have no characters, no perplexity, and are
rejected; a null language, or one with `FEW` to `LEAST` held-out documents, takes
the quantiles of all held-out documents; a language with fewer isn't judged, as
the model hasn't seen it; without any trusted text nothing but empty texts is
rejected; labels that contradict each other for one document make it untrusted;
repeated rows are judged alike, whatever their other columns are named.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.llm.common import dealt_by_bytes, fresh, map_texts, materialise, scratch_path, sent, small_batches

ORDER, BITS, FIRST_FOLDED = 5, 12, 0x600
START, REPEAT, APART, OTHER = 2, 1, 3, 4
#: Rows of the model that meet in one task.
SHARD_ROWS = 200_000
#: Texts are read in batches of about so many bytes; a partition's distinct 5-grams are written whenever there are so many.
TEXT_BYTES, MOST_GRAMS = 1 << 20, 1_000_000
HELD_OUT = 4
UPPER, LOWER_Q, SLACK, LOWER_SLACK, LEAST, FEW = 0.995, 0.0005, 1.2, 1.5, 20, 3
#: Discounts where the counts of counts give none between 0 and the count.
FALLBACK = 0.5, 1.0, 1.5
#: Nats by which one character strays: a text of n has bounds wider by exp(STRAY / sqrt(n)).
STRAY = 2.0
SCORE = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("log_p", T.DoubleType())])
PAIR = (1 << 2 * BITS) - 1


def repeats_marked(text: str) -> str:
    """Each word that equals the one before it as one mark."""
    words = text.split()
    return " ".join("\x01" if a == b else b for a, b in itertools.pairwise(["", *words]))


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The packed 5-grams that end at each character of each text, and how many each text has."""
    sizes, packed = [], []
    for t in texts:
        marked = repeats_marked(t) if t else ""
        code = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.int64)
        high = code >= FIRST_FOLDED
        if high.any():
            code = np.where(high, FIRST_FOLDED + code % ((1 << BITS) - FIRST_FOLDED), code)
        sizes.append(len(code))
        code = np.concatenate([np.full(ORDER - 1, START), code])
        out = np.zeros(sizes[-1], np.int64)
        for k in range(ORDER):
            out = (out << BITS) | code[k : k + sizes[-1]]
        out[code[ORDER - 1 :] == REPEAT] = event(REPEAT)
        packed.append(out)
    return (np.concatenate(packed) if packed else np.empty(0, np.int64)), np.array(sizes, np.int64)


def event(code: int) -> int:
    """A 5-gram whose context is the same everywhere: repetition must not become likely because the words before were repeated."""
    out = 0
    for c in (*[APART] * (ORDER - 1), code):
        out = (out << BITS) | c
    return out


def chunk_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, g, c: each partition's distinct 5-grams, and their counts in the texts to train on. Columns in: text, taught."""
    chunk = TaskContext.get().partitionId() << 16
    g, c, more, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate([g, *[x for x, _ in more]]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c, *[y for _, y in more]]), len(found)).astype(np.int64)
        more.clear()
        return found, counts

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), chunk)), pa.array(g), pa.array(c)], ["chunk", "g", "c"])

    for b in dealt_by_bytes(batches, TEXT_BYTES):
        packed, sizes = grams(b.column(0).to_pylist())
        taught = np.repeat(b.column(1).to_numpy(zero_copy_only=False), sizes)
        found, at = np.unique(packed, return_inverse=True)
        more.append((found, np.bincount(at, taught, len(found))))
        more.append((np.array([event(OTHER)]), np.array([taught[packed != event(REPEAT)].sum()])))
        held += len(found)
        if held > max(len(g), 200_000):
            (g, c), held = merged(), 0
            if len(g) > MOST_GRAMS:
                yield out()
                g, c, chunk = g[:0], c[:0], chunk + 1
    if more:
        g, c = merged()
    if len(g):
        yield out()


def lower_orders(top: DataFrame) -> list[DataFrame]:
    """Orders 1 to 5: g, c; below the top c is the number of characters seen before the n-gram."""
    out = [top]
    for k in range(ORDER - 1, 0, -1):
        kept = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
        out.insert(0, materialise(out[0].groupBy(kept.alias("g")).agg(F.count("*").alias("c")), f"order{k}"))
    return out


def discounts(orders: list[DataFrame]) -> list[tuple[float, float, float]]:
    """Modified Kneser-Ney: three discounts for each order, from how many n-grams are seen 1, 2, 3 and 4 times."""
    rows = [t.agg(F.lit(k).alias("k"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]) for k, t in enumerate(orders)]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    out = []
    for r in sorted(whole.collect()):
        n = [max(1, x) for x in r[1:]]
        y = n[0] / (n[0] + 2 * n[1])
        found = 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]
        out.append(found if all(0 < d <= i for i, d in enumerate(found, 1)) else FALLBACK)
    return out


def model_rows(orders: list[DataFrame]) -> DataFrame:
    """k, g, p (of the n-gram's last character after the others), gamma (null, but for contexts: what is left for the lower order)."""
    cuts = discounts(orders)
    below, out = None, None
    for k, (t, (d1, d2, d3)) in enumerate(zip(orders, cuts, strict=True), 1):
        context = F.shiftright("g", BITS)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        sums = t.groupBy(context.alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("taken"), F.count("*").alias("types"))
        sums = materialise(sums.select("h", "total", (F.col("taken") / F.col("total")).alias("gamma"), "types"), f"sums{k}")
        joined = t.withColumn("h", context).join(sums, "h")
        own = (F.col("c") - cut) / F.col("total")
        if k == 1:
            p = joined.select("g", (own + F.col("gamma") / (F.col("types") + 1)).alias("p"))
        else:
            low = below.select(F.col("g").alias("s"), F.col("p").alias("q"))
            suffix = F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))
            p = joined.withColumn("s", suffix).join(low, "s").select("g", (own + F.col("gamma") * F.col("q")).alias("p"))
        below = materialise(p, f"p{k}")
        rows = below.select(F.lit(k).alias("k"), "g", "p", F.lit(None).cast("double").alias("gamma")).unionByName(sums.select(F.lit(k).alias("k"), F.col("h").alias("g"), F.lit(None).cast("double").alias("p"), "gamma"))
        out = rows if out is None else out.unionByName(rows)
    return out


class Shard:
    """One shard of the model as sorted arrays."""

    def __init__(self, rows: pa.Table) -> None:
        k, g, p, gamma = (rows.column(c).to_numpy() for c in ("k", "g", "p", "gamma"))
        self.p, self.gamma = [], []
        for order in range(1, ORDER + 1):
            own = np.flatnonzero(k == order)
            own = own[np.argsort(g[own])]
            for into, value in ((self.p, p[own]), (self.gamma, gamma[own])):
                some = ~np.isnan(value)
                into.append((g[own][some], value[some]))
        self.unseen = float(self.gamma[0][1][0]) / (len(self.p[0][0]) + 1)

    def log_p(self, packed: np.ndarray) -> np.ndarray:
        """Of distinct sorted 5-grams: the longest n-gram seen, times what its longer contexts leave."""
        p = look(self.p[-1], packed, np.nan)
        left = np.flatnonzero(np.isnan(p))
        factor = np.ones(len(left))
        for k in range(ORDER - 1, 0, -1):
            if not len(left):
                break
            short = packed[left] & ((1 << BITS * k) - 1)
            context = (packed[left] & ((1 << BITS * (k + 1)) - 1)) >> BITS
            factor *= look(self.gamma[k], context, 1.0)
            found = look(self.p[k - 1], short, self.unseen if k == 1 else np.nan)
            seen = ~np.isnan(found)
            p[left[seen]] = factor[seen] * found[seen]
            left, factor = left[~seen], factor[~seen]
        return np.log(p)


def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, value = table
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return np.where(known[at] == keys, value[at], missing) if len(known) else np.full(len(keys), missing)


def shard_log_p(asked: pa.Table, model: pa.Table) -> pa.Table:
    """shard, g, log_p of one shard's 5-grams."""
    g = np.sort(asked.column("g").to_numpy())
    return pa.table({"shard": pa.array(np.full(len(g), asked.column("shard")[0].as_py() if len(g) else 0), pa.int32()), "g": pa.array(g), "log_p": pa.array(Shard(model).log_p(g) if len(g) else np.empty(0))})


def gram_log_p(grams_found: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """shard, g, log_p of all distinct 5-grams, which meet the model by shards."""
    of = lambda pair: F.pmod(pair.bitwiseAND(F.lit(PAIR)), F.lit(shards)).cast("int")
    # n-grams lie with the two characters before their last, contexts with their own last two; orders 1 and 2 go to every shard
    pair = F.when(F.col("p").isNotNull(), F.shiftright("g", BITS)).otherwise(F.col("g"))
    where = F.when(F.col("k") > 2, F.array(of(pair))).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = grams_found.select(of(F.shiftright("g", BITS)).alias("shard"), "g")
    model = rows.select(F.explode(where).alias("shard"), "k", "g", "p", "gamma")
    return asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(shard_log_p, "shard int, g bigint, log_p double")


def fitted(marked: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[str, str, int]:
    """Count, estimate and look up all 5-grams of `marked` (text, taught). Paths of their log-probabilities by partition and by shard; the number of shards (0: there was no text to train on)."""
    spark = marked.sparkSession
    small_batches(spark)
    found = materialise(marked.select("text", "taught").mapInArrow(chunk_grams, "chunk bigint, g bigint, c bigint"), "found")
    distinct = materialise(found.groupBy("g").agg(F.sum("c").alias("c")), "grams")
    rows = materialise(model_rows(lower_orders(distinct.where("c > 0"))), "model")
    if not rows.where("k = 1").head(1):
        return "", "", 0
    shards = -(-rows.where("k > 2").count() // shard_rows) or 1
    by_shard, by_chunk = scratch_path(spark, "shards"), scratch_path(spark, "chunks")
    gram_log_p(distinct, rows, shards).write.partitionBy("shard").parquet(by_shard)
    known = spark.read.schema("g bigint, log_p double, shard int").parquet(by_shard).select("g", "log_p")
    joined = found.select("chunk", "g").join(known, "g").repartition("chunk").sortWithinPartitions("chunk", "g")
    joined.write.partitionBy("chunk").parquet(by_chunk)
    return by_chunk, by_shard, shards


class Known:
    """Log-probabilities of the 5-grams of one partition, and of others where they are asked for."""

    def __init__(self, by_chunk: str, by_shard: str, shards: int) -> None:
        self.by_chunk, self.by_shard, self.shards = by_chunk, by_shard, shards
        self.chunk = TaskContext.get().partitionId() << 16
        self.table = self.read(f"{by_chunk}/chunk={self.chunk}")

    @staticmethod
    def read(path: str) -> tuple[np.ndarray, np.ndarray] | None:
        where, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        if where.get_file_info(root).type == fs.FileType.NotFound:
            return None
        rows = ds.dataset(root, filesystem=where, format="parquet").to_table(columns=["g", "log_p"])
        g, log_p = rows.column("g").to_numpy(), rows.column("log_p").to_numpy()
        order = slice(None) if (g[1:] > g[:-1]).all() else np.argsort(g)
        return g[order], log_p[order]

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Of distinct sorted 5-grams."""
        out = np.full(len(keys), np.nan)
        while self.table is not None:
            left = np.flatnonzero(np.isnan(out))
            if not len(left):
                return out
            out[left] = look(self.table, keys[left], np.nan)
            if np.isnan(out).any() and (after := self.read(f"{self.by_chunk}/chunk={self.chunk + 1}")) is not None:
                self.chunk, self.table = self.chunk + 1, after
            else:
                break
        left = np.flatnonzero(np.isnan(out))
        shard = ((keys[left] >> BITS) & PAIR) % self.shards
        for s in np.unique(shard):
            own = left[shard == s]
            out[own] = look(self.read(f"{self.by_shard}/shard={s}"), keys[own], np.nan)
        return out


def scorer(by_chunk: str, by_shard: str, shards: int):
    known = Known(by_chunk, by_shard, shards)

    def work(texts: list) -> list:
        packed, sizes = grams(texts)
        distinct, back = np.unique(packed, return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(known.log_p(distinct)[back])])
        last = np.cumsum(sizes)
        return [sizes, ends[last] - ends[last - sizes]]

    return work


def score(marked: DataFrame, model: tuple[str, str, int], keep: list[str], into: str = "s") -> DataFrame:
    """`keep` columns and a struct: n_chars, log_p. `marked` must be what the model was fitted with, or rows of it where they are."""
    if model[2]:
        return map_texts(marked, partial(scorer, *model), SCORE, "text", keep, into, TEXT_BYTES)
    n = F.char_length(F.trim(F.coalesce("text", F.lit("")))).cast("bigint")
    return marked.select(*keep, F.struct(n.alias("n_chars"), F.lit(None).cast("double").alias("log_p")).alias(into))


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return labels.groupBy(key).agg(F.min("quality").alias("worst"), F.max("quality").alias("best")).where("worst = 1 and best = 1").select(key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, into: str = "found", upper: float = UPPER, lower: float = LOWER_Q, slack: float = SLACK, lower_slack: float = LOWER_SLACK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`keep` columns and a struct: n_chars, perplexity, lowest, highest (of its language), kept."""
    keep = list(docs.columns if keep is None else keep)
    ids = trusted_ids(labels.select("doc_id", "quality")).select(F.col("doc_id").alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)).alias("fold"))
    ids = materialise(ids, "trusted")
    put = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("lang"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    marked = put.join(sent(ids), "key", "left").withColumn("taught", F.coalesce(F.col("fold") > 0, F.lit(False)))
    model = fitted(marked, shard_rows)
    size, log_p = F.col("s.n_chars"), F.col("s.log_p")
    perplexity = F.when(size > 0, F.exp(-log_p / size))
    strays = F.exp(STRAY / F.sqrt(F.greatest(size, F.lit(1))))
    known = score(marked.where("fold <= 1"), model, ["lang", "fold"]).where(perplexity.isNotNull())
    known = materialise(known.select("lang", (perplexity * strays).alias("low"), F.when(F.col("fold") == 0, perplexity / strays).alias("high")), "known")
    low, high = F.percentile_approx("low", lower, 100_000), F.percentile_approx("high", upper, 100_000)
    each = materialise(known.where("lang is not null").groupBy("lang").agg(F.count("high").alias("n"), low.alias("low"), high.alias("high")), "limits")
    whole = known.agg(low.alias("all_low"), high.alias("all_high"))
    out = score(marked, model, ["kept", "lang"]).join(each, "lang", "left").crossJoin(F.broadcast(whole))  # one row
    own, pooled = F.coalesce(F.col("n") >= LEAST, F.lit(False)), F.col("lang").isNull() | (F.col("n") >= FEW)
    bound = lambda mine, every: F.when(own, F.col(mine)).when(pooled, F.col(every))
    lowest, highest = bound("low", "all_low") / (lower_slack * strays), bound("high", "all_high") * slack * strays
    kept = (size > 0) & F.coalesce(perplexity.between(lowest, highest), F.lit(True))
    result = F.struct(size.alias("n_chars"), perplexity.alias("perplexity"), lowest.alias("lowest"), highest.alias("highest"), kept.alias("kept"))
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], result.alias(fresh(into, keep)))
