"""Listings and upkeep: stores, label sets, staging, catalogues, runs, and the ways lists are filtered and sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions.identity import natural_key

TIER_ORDER = ("normal", "critical", "negative")


def missing_arrays(images: DataFrame, features: DataFrame) -> DataFrame:
    """Images of the list without any stored row."""
    return images.join(features.select("entry").distinct(), "entry", "left_anti")


def listing(images: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every image with its assignment; tier "" and severity 0 without one."""
    out = images.join(assignments.select("entry", "tier", "label", "severity"), "entry", "left")
    return out.withColumns({"tier": F.coalesce("tier", F.lit("")), "label": F.when(F.col("tier") == "normal", "").otherwise(F.coalesce("label", F.lit(""))), "severity": F.coalesce("severity", F.lit(0))})


def upsert(rows: DataFrame, changes: DataFrame, key: str = "entry") -> DataFrame:
    """Rows of `changes` in place of those with their key."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes.select(rows.columns))


def marked(assignments: DataFrame, marks: DataFrame) -> DataFrame:
    """Assignments with marks (entry, marks) in place of their own: sorted, distinct, none in the normal tier."""
    new = marks.select("entry", F.array_sort(F.array_distinct("marks")).alias("__marks"))
    none = F.array().cast(assignments.schema["marks"].dataType)
    return assignments.join(new, "entry", "left").withColumn("marks", F.when(F.col("tier") == "normal", none).otherwise(F.coalesce("__marks", "marks"))).drop("__marks")


def cascade_delete(images: DataFrame, assignments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the entries in `gone`."""
    ids = gone.select("entry").distinct()
    return images.join(ids, "entry", "left_anti"), assignments.join(ids, "entry", "left_anti")


def reconciled(files: DataFrame, known: DataFrame, key: str = "name") -> DataFrame:
    """What is known of the files there are: entries of files that went go, new files come with nulls."""
    return files.select(key).distinct().join(known, key, "left")


def sync_changes(files: DataFrame, index: DataFrame, key: str = "name") -> DataFrame:
    """key and change: added, removed or kept."""
    both = files.select(key, F.lit(1).alias("f")).distinct().join(index.select(key, F.lit(1).alias("i")).distinct(), key, "full")
    return both.select(key, F.when(F.col("i").isNull(), "added").when(F.col("f").isNull(), "removed").otherwise("kept").alias("change"))


def census(banks: DataFrame, by: str = "project") -> DataFrame:
    """Sums over banks and the basis they share, or mixed. banks: by, images, labelled, staged, basis."""
    sums = [F.sum(c).alias(c) for c in ("images", "labelled", "staged")]
    return banks.groupBy(by).agg(*sums, F.when(F.min("basis") == F.max("basis"), F.min("basis")).otherwise("mixed").alias("basis"))


def chosen(candidates: DataFrame, remembered: str | None, key: str, fallback: str) -> DataFrame:
    """One row: the remembered one if it is there, else the first by name, else the fallback."""
    there = F.max(F.when(F.col(key) == F.lit(remembered), F.col(key)))
    return candidates.agg(F.coalesce(there, F.min(key), F.lit(fallback)).alias(key))


def best_run(runs: DataFrame, by: str) -> DataFrame:
    """by, run, f1: the run with a model and the highest F1 above 0, the first of equals. runs: by, run, position, f1, has_model."""
    best = runs.where("has_model and f1 > 0").groupBy(by).agg(F.max_by(F.struct("run", "f1"), F.struct("f1", -F.col("position"))).alias("b"))
    return best.select(by, "b.run", "b.f1")


def default_run(runs: DataFrame, by: str) -> DataFrame:
    """by, run: the first that is running, else the first."""
    return runs.groupBy(by).agg(F.min_by("run", F.struct(F.col("status") != "running", "position")).alias("run"))


def swept_runs(runs: DataFrame, directories: DataFrame) -> DataFrame:
    """Runs that have a directory; those left as running have failed."""
    return runs.join(directories.select("run").distinct(), "run", "left_semi").withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def tier_counts(listed: DataFrame) -> DataFrame:
    """tier and images for every tier and for unlabelled ones (""), zeros too."""
    tiers = listed.sparkSession.createDataFrame([(t,) for t in ("", *TIER_ORDER)], "tier string")
    return tiers.join(listed.groupBy("tier").agg(F.count("*").alias("images")), "tier", "left").na.fill(0)


def label_counts(listed: DataFrame, position: str) -> DataFrame:
    """label, images, first: defect kinds, to be sorted by count and then by first position."""
    return listed.where("tier = 'critical' and label <> ''").groupBy("label").agg(F.count("*").alias("images"), F.min(position).alias("first"))


def tag_filter(tags: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of `include` and none of `exclude`; an empty list asks for nothing."""
    out = F.lit(True)
    if include:
        out = out & F.arrays_overlap(tags, F.array(*map(F.lit, include)))
    if exclude:
        out = out & ~F.arrays_overlap(tags, F.array(*map(F.lit, exclude)))
    return out


def sort_columns(order: str, name: str = "name", score: str = "score", tier: str = "tier") -> list[Column]:
    """name and -name sort naturally; score and -score put unscored last; tier by rank, then name."""
    key = natural_key(F.col(name))
    rank = F.array_position(F.array(*map(F.lit, TIER_ORDER)), F.col(tier))
    return {"name": [key.asc(), F.asc(name)], "-name": [key.desc(), F.desc(name)], "score": [F.asc_nulls_last(score), F.asc(name)], "-score": [F.desc_nulls_last(score), F.asc(name)], "tier": [F.when(rank == 0, 9).otherwise(rank).asc(), key.asc(), F.asc(name)]}[order]


def upload_guard(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """One row: files, bytes, and whether the batch is within both limits and no name leaves its folder. files: name, bytes."""
    outside = F.col("name").rlike(r"(^|[/\\])\.\.([/\\]|$)") | F.col("name").rlike(r"^([/\\]|[A-Za-z]:)")
    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(outside).alias("outside"))
    return out.withColumn("accepted", (F.col("files") <= most_files) & (F.col("bytes") <= most_bytes) & (F.col("outside") == 0))


def archive_guard(members: DataFrame, uploaded: int) -> DataFrame:
    """One row: whether an archive's members come to at most eight times the upload, or 64 MiB."""
    return members.agg(F.sum("bytes").alias("bytes")).withColumn("accepted", F.col("bytes") <= F.greatest(F.lit(8 * uploaded), F.lit(64 << 20)))


def first_seen(rows: DataFrame, name: str, position: str) -> DataFrame:
    """Distinct names with their first position."""
    return rows.groupBy(name).agg(F.min(position).alias("first"))


def with_defaults(settings: DataFrame, defaults: dict[str, object], limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Settings with defaults for what is missing, held within limits."""
    out = settings
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in out.columns else F.lit(value))
    for c, (low, high) in (limits or {}).items():
        out = out.withColumn(c, F.greatest(F.lit(low), F.least(F.lit(high), F.col(c))))
    return out


def profile(files: DataFrame, sample: int = 500) -> DataFrame:
    """One row: files and bytes, and mean and largest size of a sample at an even stride of a hash. files: path, bytes."""
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    share = F.greatest(F.lit(1), F.floor(F.col("files") / sample))
    picked = files.crossJoin(F.broadcast(total.select("files"))).where(F.pmod(F.xxhash64("path"), share) == 0)  # one row
    return total.crossJoin(F.broadcast(picked.agg(F.count("*").alias("sampled"), F.avg("bytes").alias("mean_bytes"), F.max("bytes").alias("max_bytes"))))


def ranged(rows: DataFrame, order: list[Column], first: Column, last: Column, by: str) -> DataFrame:
    """Rows of each list between two anchors in the order shown, whichever comes first."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    ends = numbered.where(first | last).groupBy(by).agg(F.min("__n").alias("__a"), F.max("__n").alias("__b"))
    return numbered.join(ends, by).where("__n between __a and __b").drop("__n", "__a", "__b")


def resolved_images(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (id, entry, name, tier) with path: by entry, else by name in its tier, else by a name that only one file has. files: path, entry, name, tier."""
    unique = files.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("name", F.col("path").alias("p3"))
    by_entry = files.groupBy("entry").agg(F.min("path").alias("p1"))
    by_name = files.groupBy("name", "tier").agg(F.min("path").alias("p2"))
    out = wanted.join(by_entry, "entry", "left").join(by_name, ["name", "tier"], "left").join(unique, "name", "left")
    return out.select(wanted.columns + [F.coalesce("p1", "p2", "p3").alias("path")])


def bank_listing(bank: DataFrame) -> DataFrame:
    """tier, label, entry and rows of every image in the bank."""
    return bank.groupBy("tier", "label", "entry").agg(F.count("*").alias("rows"))


def set_groups(images: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with groups set by hand (entry, grp), trimmed; and the entries that aren't known."""
    named = given.select("entry", F.trim("grp").alias("__grp"))
    out = images.join(named, "entry", "left").withColumn("grp", F.coalesce("__grp", "grp")).drop("__grp")
    return out, given.join(images, "entry", "left_anti").select("entry")


def coverage(bank: DataFrame, index: DataFrame) -> DataFrame:
    """tier, label, rows, covered, uncovered: how far an index of (tier, label, entry, count) accounts for a bank's rows."""
    rows = bank.groupBy("tier", "label").agg(F.count("*").alias("rows"))
    covered = index.groupBy("tier", "label").agg(F.sum("count").alias("covered"))
    out = rows.join(covered, ["tier", "label"], "left").na.fill(0, ["covered"])
    return out.withColumn("uncovered", F.col("rows") - F.col("covered"))


def integrity(index: DataFrame, files: DataFrame, masks: DataFrame) -> DataFrame:
    """kind and number: index entries without a file, masks without an image, and entries whose mask flag is wrong. index: name, has_mask."""
    ghosts = index.join(files, "name", "left_anti").agg(F.count("*").alias("n")).select(F.lit("ghost").alias("kind"), "n")
    orphans = masks.join(files, "name", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan_mask").alias("kind"), "n")
    flagged = index.join(masks.select("name", F.lit(True).alias("m")).distinct(), "name", "left")
    wrong = flagged.agg(F.count_if(F.col("has_mask") != F.coalesce("m", F.lit(False))).alias("n")).select(F.lit("wrong_flag").alias("kind"), "n")
    return ghosts.unionByName(orphans).unionByName(wrong)


def n_classes(classes: DataFrame) -> DataFrame:
    """One row: one more than the largest id, 2 without classes; a missing id counts as 0."""
    return classes.agg(F.coalesce(F.max(F.coalesce("id", F.lit(0))) + 1, F.lit(2)).alias("n"))


def project_order(kind: str) -> list[Column]:
    return {"custom": [F.coalesce("sort_order", F.lit(0)).asc(), F.asc("name")], "newest": [F.desc("created"), F.asc("name")], "oldest": [F.asc("created"), F.asc("name")], "name": [F.lower("name").asc()], "-name": [F.lower("name").desc()]}[kind]


def reordered(projects: DataFrame, ids: list[int]) -> DataFrame:
    """Projects with sort_order from the list's places; others keep theirs."""
    if not ids:
        return projects
    place = F.array_position(F.array(*[F.lit(i).cast("bigint") for i in ids]), F.col("id").cast("bigint"))
    return projects.withColumn("sort_order", F.when(place > 0, place - 1).otherwise(F.col("sort_order")))
