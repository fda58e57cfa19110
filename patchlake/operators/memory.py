"""The bank's rows over time: append, annotate, remove, clear, hits, decay, sizes.

Banks are tables of rows keyed by tier, label, entry and row; every change gives
a new table. Labelled tiers carry severity, registered_at, last_hit, hit_count
and memory (0 short, 1 mid, 2 long). Time is the count of inspections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions.scoring import DEFAULT_SEVERITY, clamped_severity, freshness

TO_MID, TO_LONG, RETIRE_BELOW = 3, 10, 0.05
KEY = ("tier", "label", "entry", "row")


def with_defaults(rows: DataFrame, now: int) -> DataFrame:
    """Metadata that is missing, with its defaults."""
    defaults = {"severity": F.lit(DEFAULT_SEVERITY), "registered_at": F.lit(now).cast("bigint"), "last_hit": F.lit(now).cast("bigint"), "hit_count": F.lit(0).cast("bigint"), "memory": F.lit(0)}
    return rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})


def append(bank: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """Rows of new entries with metadata defaults; the normal tier has no label."""
    label = F.when(F.col("tier") == "normal", "").otherwise(F.col("label"))
    return bank.unionByName(with_defaults(rows.withColumn("label", label), now).select(bank.columns))


def annotate(bank: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of the entries in `marks` (entry, row, severity; row null: clear) get the default severity, marked ones their own."""
    given = marks.where("row is not null").groupBy("entry", "row").agg(clamped_severity(F.max("severity")).alias("given"))
    touched = marks.select("entry").distinct().withColumn("touched", F.lit(True))
    out = bank.join(touched, "entry", "left").join(given, ["entry", "row"], "left")
    return out.withColumn("severity", F.when(F.col("touched"), F.coalesce("given", F.lit(DEFAULT_SEVERITY))).otherwise(F.col("severity"))).select(bank.columns)


def remove(bank: DataFrame, entries: DataFrame) -> DataFrame:
    return bank.join(entries.select("entry"), "entry", "left_anti").select(bank.columns)


def clear(bank: DataFrame, tier: str, label: str | None = None) -> DataFrame:
    """Without a labelled tier, or one label of it; the normal tier can't be cleared."""
    if tier == "normal":
        raise ValueError("the normal tier is protected")
    gone = F.col("tier") == tier
    return bank.where(~(gone if label is None else gone & (F.col("label") == label)))


def row_starts(rows: DataFrame) -> DataFrame:
    """tier, label, entry, start, count: where each entry's rows lie when a label's entries are put one after the other."""
    from patchlake.operators.ordered import totals_before

    counts = rows.groupBy("tier", "label", "entry").agg(F.count("*").alias("count"))
    return totals_before(counts, "entry", {"start": F.col("count")}, ("tier", "label"))


def hit(bank: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """Rows hit in one call: last_hit is now, hit_count one more, however often the call names them. hits: the key's columns."""
    once = hits.select(*KEY).distinct().withColumn("was_hit", F.lit(True))
    out = bank.join(once, list(KEY), "left")
    return out.withColumns({"last_hit": F.when(F.col("was_hit"), F.lit(now).cast("bigint")).otherwise(F.col("last_hit")), "hit_count": F.col("hit_count") + F.coalesce(F.col("was_hit").cast("bigint"), F.lit(0))}).select(bank.columns)


def decay_marks(now: Column | int) -> dict[str, Column]:
    """What decay does to a row, all judged before anything changes."""
    now = F.lit(now) if isinstance(now, int) else now
    short = F.col("memory") == 0
    return {
        "to_mid": short & (F.col("hit_count") >= TO_MID),
        "to_long": (F.col("memory") == 1) & (F.col("hit_count") >= TO_LONG),
        "retire": short & (freshness(now, F.col("last_hit"), F.col("memory")) < RETIRE_BELOW),
    }


def decay_counts(bank: DataFrame, now: int) -> DataFrame:
    """What a run would do, for each labelled tier and label."""
    return bank.where("tier <> 'normal'").groupBy("tier", "label").agg(*[F.count_if(c).alias(n) for n, c in decay_marks(now).items()])


def decay(bank: DataFrame, now: int) -> DataFrame:
    """The bank after a run: one step up at most, and stale short rows go."""
    marks, labelled = decay_marks(now), F.col("tier") != "normal"
    out = bank.where(~(labelled & marks["retire"]))
    return out.withColumn("memory", F.when(labelled & marks["to_mid"], 1).when(labelled & marks["to_long"], 2).otherwise(F.col("memory")))


def sizes(bank: DataFrame) -> DataFrame:
    """tier, label, rows; totals with null label and null tier."""
    return bank.rollup("tier", "label").agg(F.count("*").alias("rows"))


def capacity(bank: DataFrame, ceiling: int, dim: int) -> DataFrame:
    """rows, pct of the ceiling (at most 100) and MB of half-precision vectors."""
    n = F.count("*")
    return bank.agg(n.alias("rows"), F.least(F.lit(100.0), F.bround(n / F.lit(ceiling) * 100, 1)).alias("pct"), F.round(n * dim * 2 / 1048576).cast("bigint").alias("mb"))


def carried_over(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """Metadata of a bank assembled before: by tier, label, entry and row where the entry's count is the same; by name where it had no entry."""
    names = ["severity", "registered_at", "last_hit", "hit_count", "memory"]
    count = lambda t, by: t.groupBy(*by).agg(F.count("*").alias("n"))
    by_entry, by_name = ["tier", "label", "entry"], ["tier", "label", "name"]
    sized = rows.join(count(rows, by_entry), by_entry)
    with_id, without = previous.where("entry is not null"), previous.where("entry is null")
    first = with_id.join(count(with_id, by_entry), by_entry).select(*by_entry, "row", "n", F.struct(*names).alias("by_entry"))
    second = without.join(count(without, by_name), by_name).select(*by_name, "row", "n", F.struct(*names).alias("by_name"))
    out = sized.join(first, [*by_entry, "row", "n"], "left").join(second, [*by_name, "row", "n"], "left")
    kept = F.coalesce("by_entry", "by_name")
    return out.withColumns({c: F.coalesce(kept[c], F.col(c)) for c in names}).select(rows.columns)
