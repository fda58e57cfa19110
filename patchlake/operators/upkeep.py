"""Upkeep of stores, banks and projects: new ids, places of rows, counters, ceilings, staged inputs, states, lookups, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.operators.masks import IGNORED, orphan_classes
from patchlake.operators.memory import row_starts
from patchlake.operators.ordered import totals_before

#: File endings of images, in the order they are tried.
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")


def padded_id(number: Column) -> Column:
    """At least six digits; longer numbers stay whole."""
    digits = number.cast("string")
    return F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


def with_new_ids(arrivals: DataFrame, order: str, last_given: int) -> DataFrame:
    """Arrivals with entry_id: numbers after the last one ever given, so ids of removed entries don't come back. `order` is distinct."""
    out = totals_before(arrivals, order, {"__before": F.lit(1)})
    return out.withColumn("entry_id", padded_id(F.col("__before") + F.lit(last_given + 1))).drop("__before")


def features_of(features: DataFrame, entries: DataFrame) -> DataFrame:
    """Stored rows of the wanted entries; unknown ones give none."""
    return features.join(entries.select("entry").distinct(), "entry", "left_semi")


def placed_rows(rows: DataFrame) -> DataFrame:
    """The rows with position: their place in the tier and label, entries one after the other. Rows of an entry count from 0."""
    starts = row_starts(rows).select("tier", "label", "entry", "start")
    return rows.join(starts, ["tier", "label", "entry"]).withColumn("position", F.col("start") + F.col("row")).drop("start")


def images_at(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """positions (tier, label, position, ...) with entry and row; places outside of the bank give none."""
    return positions.join(placed_rows(rows).select("tier", "label", "position", "entry", "row"), ["tier", "label", "position"])


def cluster_places(rows: DataFrame, cluster: str, order: str) -> DataFrame:
    """The rows with place: where each lies when sorted by cluster and, within it, by the distinct order column."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("__n"))
    before = totals_before(sizes, cluster, {"__smaller": F.col("__n")}).select(cluster, "__smaller")
    within = totals_before(rows, order, {"__within": F.lit(1)}, (cluster,))
    return within.join(before, cluster).withColumn("place", F.col("__smaller") + F.col("__within")).drop("__smaller", "__within")


def combined(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Parts of a bank as one; a column that a part lacks is null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def ticked(counters: DataFrame, inspections: DataFrame, key: str = "bank") -> DataFrame:
    """Each bank's counter, one higher for each inspection. counters: key, counter; inspections: key."""
    new = inspections.groupBy(key).agg(F.count("*").alias("__new"))
    return counters.join(new, key, "left").withColumn("counter", F.col("counter") + F.coalesce("__new", F.lit(0))).drop("__new")


def chunk_rows(bank_rows: Column, free_bytes: Column, element_bytes: int = 2, overhead: float = 3.0) -> Column:
    """Queries whose distances to the bank fit in 60 % of the free bytes, from 32 to 4,096; 4,096 for an empty bank."""
    fits = F.floor(free_bytes * 0.6 / (bank_rows * element_bytes * overhead))
    return F.when(bank_rows <= 0, F.lit(4096)).otherwise(F.greatest(F.lit(32), F.least(F.lit(4096), fits))).cast("bigint")


def ceilings(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """capacity, ceiling: overrides (capacity, value as text) that are whole numbers, none below 0, in place of the defaults; others are ignored."""
    value = F.when(F.trim("value").rlike(r"^[+-]?[0-9]+$"), F.expr("try_cast(trim(value) as bigint)"))
    given = overrides.select("capacity", F.greatest(F.lit(0), value).alias("__given")).where(value.isNotNull())
    return defaults.join(given, "capacity", "left").select("capacity", F.coalesce("__given", "ceiling").alias("ceiling"))


def bank_ceiling(banks: DataFrame, limits: DataFrame, default: str = "medium") -> DataFrame:
    """Banks with the ceiling of their capacity; the default's for a name that is missing or unknown. limits: capacity, ceiling, few and distinct."""
    known = limits.select("capacity", F.lit(True).alias("__known"))
    named = banks.join(known, "capacity", "left").withColumn("capacity", F.when(F.col("__known"), F.col("capacity")).otherwise(default)).drop("__known")
    return named.join(limits, "capacity", "left").withColumn("ceiling", F.coalesce("ceiling", F.lit(0)))


def consumed(staged: DataFrame, taken: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """Staged inputs that reached the bank with at least one row, and those that stay. taken: key, taken."""
    reached = taken.where("taken > 0").select(key).distinct()
    return staged.join(reached, key, "left_semi"), staged.join(reached, key, "left_anti")


def stale(banks: DataFrame, states: DataFrame, key: str = "bank") -> DataFrame:
    """Banks with stale: true without a state, or where the label set or the fingerprint is another than when it was assembled."""
    before = states.select(key, F.col("labelset").alias("__labelset"), F.col("fingerprint").alias("__fingerprint"), F.lit(True).alias("__there"))
    same = F.col("labelset").eqNullSafe(F.col("__labelset")) & F.col("fingerprint").eqNullSafe(F.col("__fingerprint"))
    return banks.join(before, key, "left").withColumn("stale", F.col("__there").isNull() | ~same).select(*banks.columns, "stale")


def reconciled_classes(classes: DataFrame, indexed: DataFrame, pixels: DataFrame) -> DataFrame:
    """Classes (id, name) with those that masks show and the list lacks; the masks are read only if the index (id) names such a one."""
    if indexed.join(classes, "id", "left_anti").where(~F.col("id").isin(0, IGNORED)).isEmpty():
        return classes
    return classes.unionByName(orphan_classes(pixels, classes), allowMissingColumns=True)


def found_items(wanted: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (project, id) with filename: the one in the index if the id is there, else the id with the first ending that a file has; null if there is no such file."""
    listed = index.where("filename is not null and filename <> ''").groupBy("project", "id").agg(F.min("filename").alias("__named"))
    present = files.select("project", "filename").distinct()
    endings = F.array(*map(F.lit, IMAGE_ENDINGS))
    tries = wanted.join(listed, ["project", "id"], "left").withColumn("__try", F.when(F.col("__named").isNotNull(), F.array("__named")).otherwise(F.transform(endings, lambda e: F.concat(F.col("id").cast("string"), e))))
    each = tries.select("project", "id", F.posexplode("__try").alias("__i", "filename")).distinct()
    first = each.join(present, ["project", "filename"], "left_semi").groupBy("project", "id").agg(F.min_by("filename", "__i").alias("filename"))
    return wanted.join(first, ["project", "id"], "left")


def latest_exports(exports: DataFrame) -> DataFrame:
    """project, name: the last export of each project by name."""
    return exports.groupBy("project").agg(F.max("name").alias("name"))


def project_scan(files: DataFrame, index: DataFrame) -> DataFrame:
    """project, added, removed, kept: what a sync of each project's index with its files changes. Both: project, name."""
    a = files.select("project", "name", F.lit(1).alias("f")).distinct()
    both = a.join(index.select("project", "name", F.lit(1).alias("i")).distinct(), ["project", "name"], "full")
    new, gone = F.col("i").isNull(), F.col("f").isNull()
    return both.groupBy("project").agg(F.count_if(new).alias("added"), F.count_if(gone).alias("removed"), F.count_if(~new & ~gone).alias("kept"))


def updated(projects: DataFrame, changes: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Projects with the values of `changes` (key and some columns; null: as it was), and updated_at set to now where one was named."""
    fields = [c for c in changes.columns if c != key]
    given = changes.select(key, F.struct(*fields).alias("__new") if fields else F.lit(None).alias("__new"), F.lit(True).alias("__touched"))
    out = projects.join(given, key, "left").withColumns({c: F.coalesce(F.col("__new")[c], F.col(c)) for c in fields})
    return out.withColumn("updated_at", F.when(F.col("__touched"), now).otherwise(F.col("updated_at"))).select(projects.columns)


def logged(audit: DataFrame, targets: DataFrame, action: str, kind: str, at: Column) -> DataFrame:
    """The audit log with one line for each target (id)."""
    return audit.unionByName(targets.select(F.lit(action).alias("action"), F.lit(kind).alias("target_type"), F.col("id").cast("string").alias("target_id"), at.alias("at")))
