"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words. Sources share all words by their weights,
`SHARES` in turn by name; a source's target stops at `most` times its size, and what
is too much goes to the others by weight, until none is above. The level at which
this ends comes from one sort of the sources (a row each), not from rounds.

A source whose target is e sizes and a rest has every document e times (complete
epochs first). The rest is drawn: each document gets the key -ln(u) / weight, where
u is a hash of its id and text, so a run repeated gives the same; smallest keys are
taken first, until the sizes so far reach the rest. The document in which that
happens is taken up to the word that fills it, so that a source misses its target by
less than a word.

No source is sorted as a whole. Keys lie in an interval that is cut into `BUCKETS`;
sums by bucket show in which one the rest is reached, and that bucket is cut again
until it has at most `SORTED` rows, or all its keys are equal. Only these rows are
sorted, those before are taken and those after are not. Texts are read once.

Defined cases: null texts have size 0; null sources are one source, the last; a
null key is hashed as such; null weights count as 1, weights that aren't positive
numbers come last; repeated rows are each drawn and tie, and whichever of them is
taken gives the same rows; a source without words has target 0; an empty table
gives no rows; a name that `keep` has gets underscores before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.llm.common import fresh, map_texts, materialise, sent

SHARES = (1, 2, 3)
MOST = 3
BUCKETS = 4096
#: So many rows of one source at most are sorted in one task, but for equal keys.
SORTED = 100_000
SEED = "mix"
RESULT = ("size", "source_size", "target", "taken")


def word_counter():
    def work(texts: list) -> list:
        return [[len(t.encode().split()) if t else 0 for t in texts]]

    return work


def uniform(*parts: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    drawn = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, shares: tuple[int, ...] = SHARES, most: int = MOST) -> DataFrame:
    """source, source_size, target of each row of (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), (F.row_number().over(by_name) - 1) % len(shares) + 1)
    rows = sizes.select("source", "source_size", share.cast("bigint").alias("share"))
    full = F.col("source_size") * most / F.col("share")  # the level at which a source is full
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    rows = rows.withColumn("level", full)
    rows = rows.select(
        "*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("sizes_before"), F.coalesce(F.sum("share").over(before), F.lit(0)).alias("shares_before"),
        F.sum("source_size").over(everything).alias("sizes"), F.sum("share").over(everything).alias("all_shares"),
    )
    # if all sources before are full and this one and all after aren't, these share the rest
    rows = rows.withColumn("even", (F.col("sizes") - most * F.col("sizes_before")) / (F.col("all_shares") - F.col("shares_before")))
    rows = rows.withColumn("reached", F.min(F.when(F.col("even") <= F.col("level"), F.struct("level", "even"))).over(everything)["even"])
    target = F.least(F.col("reached") * F.col("share"), (F.col("source_size") * most).cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def boundaries(rows: DataFrame, rest: DataFrame, buckets: int, most_rows: int) -> DataFrame:
    """source, low, high, before: the rest of a source is reached among its documents with low <= v <= high; `before` words have a larger v. rows: source, v, size; rest: source, rest."""
    cuts = rest.select("source", "rest", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("bigint").alias("before"))
    while True:
        inside = rows.join(sent(cuts), rows["source"].eqNullSafe(cuts["source"]) & rows["v"].between(cuts["low"], cuts["high"])).drop(cuts["source"])
        width = F.col("high") - F.col("low")
        bucket = F.when(width > 0, F.floor((F.col("v") - F.col("low")) / width * (buckets - 1))).otherwise(0)
        sums = inside.groupBy("source", "rest", "before", bucket.alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        running = Window.partitionBy("source").orderBy(F.col("b").desc())  # at most `buckets` rows
        so_far = sums.withColumn("upto", F.col("before") + F.sum("n").over(running)).where("upto >= rest")
        first = so_far.groupBy("source", "rest").agg(F.max_by(F.struct("low", "high", "rows", (F.col("upto") - F.col("n")).alias("before")), "b").alias("x"))
        cuts = materialise(first.select("source", "rest", "x.*"), "cuts")
        if not cuts.where((F.col("rows") > most_rows) & (F.col("high") > F.col("low"))).limit(1).count():
            return cuts.select("source", "rest", "low", "high", "before")


def mix(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, shares: tuple[int, ...] = SHARES, most: int = MOST, seed: str = SEED, buckets: int = BUCKETS, most_rows: int = SORTED) -> DataFrame:
    """`keep` columns (all by default), size, source_size, target (the source's) and taken (words the mix takes, repeats counted). weights: `key`, weight (quality; distinct keys)."""
    keep = list(docs.columns if keep is None else keep)
    put = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"),
        F.col(f"`{text}`").alias("text"), uniform(F.col(f"`{key}`"), F.md5(F.col(f"`{text}`")), seed=seed).alias("u"),
    )
    sized = map_texts(put, word_counter, T.StructType([T.StructField("size", T.LongType())]), "text", ["kept", "id", "source", "u"], "counted").select("kept", "id", "source", "u", "counted.size")
    sized = materialise(sized, "sized")
    if weights is None:
        weighed = sized.withColumn("weight", F.lit(1.0))
    else:
        given = materialise(weights.select(F.col(f"`{key}`").alias("id"), F.col("weight").cast("double").alias("weight")), "weights")
        weighed = sized.join(sent(given), "id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    usable = (F.col("weight") > 0) & ~F.isnan("weight")
    # exp(-key) falls as the key grows and lies between 0 and 1
    rows = weighed.withColumn("v", F.when(usable, F.exp(F.ln("u") / F.col("weight"))).otherwise(0.0))
    aims = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), shares, most), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    aims = aims.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    cuts = boundaries(rows.select("source", "v", "size"), aims.where("rest > 0").select("source", "rest"), buckets, most_rows).withColumnRenamed("source", "cut_source").drop("rest")
    aims = materialise(aims.join(cuts, aims["source"].eqNullSafe(cuts["cut_source"]), "left").drop("cut_source"), "aims")
    rows = rows.join(sent(aims.withColumnRenamed("source", "aim_source")), F.col("source").eqNullSafe(F.col("aim_source")))
    at = F.col("v").between(F.col("low"), F.col("high"))
    running = Window.partitionBy("source").orderBy(F.col("v").desc(), "id", "size", "u").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(running), F.lit(0))
    sorted_rows = rows.where(at).withColumn("part", F.greatest(F.lit(0), F.least("size", left)))
    other = rows.where(~F.coalesce(at, F.lit(False))).withColumn("part", F.when(F.col("v") > F.col("high"), F.col("size")).otherwise(0))
    both = sorted_rows.unionByName(other)
    made = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("epochs") * F.col("size") + F.col("part")}
    return both.select(*[F.col("kept").getField(c).alias(c) for c in keep], *[c.alias(fresh(n, keep)) for n, c in made.items()])


def copies(mixed: DataFrame, size: str = "size", taken: str = "taken") -> DataFrame:
    """A row for each time that a document is taken: its columns, copy (from 0) and words (fewer than its size where the mix takes it in part)."""
    n, t = F.col(f"`{size}`"), F.col(f"`{taken}`")
    times = F.when(t > 0, F.sequence(F.lit(0), F.ceil(t / n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    out = mixed.withColumn(fresh("copy", mixed.columns), F.explode(times))
    return out.withColumn(fresh("words", out.columns), F.least(n, t - F.col(out.columns[-1]) * n))
