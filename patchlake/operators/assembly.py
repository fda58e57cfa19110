"""From stored images and a label set to a bank: assignment, budgets, coresets, marks, fingerprints, migration, diffs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.functions.digest import SUMS, digest, row_sums, sums_of
from patchlake.functions.identity import safe_label
from patchlake.functions.scoring import DEFAULT_SEVERITY, clamped_severity
from patchlake.operators.knn import nearest_mean
from patchlake.operators.memory import append, row_starts, with_defaults
from patchlake.operators.ordered import totals_before
from patchlake.sources.shared import materialise

TIERS = ("normal", "critical", "negative")
PROJECTED, STEP, SEED = 128, 64, 42


def assigned(images: DataFrame, assignments: DataFrame) -> DataFrame:
    """Images with an assignment to a known tier; labels as names, none in the normal tier."""
    label = F.when(F.col("tier") == "normal", "").otherwise(safe_label(F.col("label")))
    return images.join(assignments.where(F.col("tier").isin(*TIERS)), "entry").withColumn("label", label).withColumn("severity", clamped_severity(F.coalesce("severity", F.lit(DEFAULT_SEVERITY))))


def budgets(images: DataFrame, ceiling: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `images` (keys, entry, rows) and budget: a max-min fair split of `ceiling` rows.

    In ascending order an image takes its rows while they are at most an equal
    share of what is left; the first that wants more, and all after it, share the
    rest, the remainder going to the last ones.
    """
    if ceiling <= 0:
        return images.withColumn("budget", F.col("rows"))
    sizes = images.groupBy(*keys, "rows").agg(F.count("*").alias("c"))
    before = totals_before(sizes, "rows", {"taken": F.col("rows") * F.col("c"), "passed": F.col("c")}, keys)
    whole = images.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("rows").alias("total"))
    join = lambda a, b: a.join(b, list(keys)) if keys else a.crossJoin(F.broadcast(b))  # noqa: E731  one row
    put = join(before, whole)
    share = F.greatest(F.lit(1), F.floor((F.lit(ceiling) - F.col("taken")) / (F.col("n") - F.col("passed"))))
    wants_more = put.withColumn("share", share).where("rows > share").groupBy(*keys).agg(F.min_by(F.struct("taken", "passed"), "rows").alias("at"))
    cut = put.groupBy(*keys).agg(F.any_value("n").alias("n"), F.any_value("total").alias("total"))
    limits = (cut.join(wants_more, list(keys), "left") if keys else cut.crossJoin(F.broadcast(wants_more))).select(*keys, "n", "total", "at")  # one row
    left, images_left = F.lit(ceiling) - F.col("at.taken"), F.col("n") - F.col("at.passed")
    ranked = totals_by_rank(images, keys)
    out = join(ranked, limits)
    place = F.col("__rank") - F.col("at.passed")  # from 0 among those that share
    low = F.floor(left / images_left)
    fair = F.greatest(F.lit(1), low + (place >= images_left - (left - low * images_left)).cast("int"))
    budget = F.when((F.col("total") <= ceiling) | F.col("at").isNull() | (place < 0), F.col("rows")).otherwise(F.least(F.col("rows"), fair))
    return out.withColumn("budget", budget.cast("bigint")).select(*images.columns, "budget")


def totals_by_rank(images: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each image's place `__rank`, from 0, by rows and then entry (a number)."""
    sizes = images.groupBy(*keys, "rows").agg(F.count("*").alias("c"))
    smaller = totals_before(sizes, "rows", {"__smaller": F.col("c")}, keys).drop("c")
    among = totals_before(images, "entry", {"__among": F.lit(1)}, (*keys, "rows"))
    return among.join(smaller, [*keys, "rows"]).withColumn("__rank", F.col("__smaller") + F.col("__among"))


def projected(x: np.ndarray, dims: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    """A sparse random projection (density 1/sqrt(D)) if there are more dimensions than `dims`."""
    d = x.shape[1]
    if d <= dims:
        return x
    rng, density = np.random.default_rng(seed), 1 / np.sqrt(d)
    signs = rng.choice([-1.0, 0.0, 1.0], size=(d, dims), p=[density / 2, 1 - density, density / 2])
    return x @ signs / np.sqrt(density * dims)


def k_center(x: np.ndarray, n: int, forced: list[int] | None = None, step: int = STEP, seed: int = SEED, near: np.ndarray | None = None) -> list[int]:
    """Rows in the order they are chosen: forced ones, then again and again those farthest from all chosen so far and from the rows held already, which are `near` (squared) away from each."""
    n = min(max(n, len(forced or [])), len(x))
    if n <= 0:
        return []
    x = projected(np.asarray(x, np.float64))
    near = np.full(len(x), np.inf) if near is None else np.array(near, np.float64)
    held = bool(np.isfinite(near).any())
    chosen = list(forced or ([int(near.argmax())] if held else [int(np.random.default_rng(seed).integers(len(x)))]))
    new = chosen
    while len(chosen) < n:
        for i in new:
            near = np.minimum(near, ((x - x[i]) ** 2).sum(axis=1))
        near[chosen] = -1
        new = np.argsort(-near, kind="stable")[: min(step, n - len(chosen))].tolist()
        chosen += new
    return chosen[:n]


def reduced_rows(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("row").reset_index(drop=True)
    n = int(group["budget"].iloc[0])
    forced = group.index[group["forced"]].tolist()
    near = group["near"].to_numpy(np.float64) if group["near"].notna().any() else None
    order = k_center(np.array(group["vec"].tolist()), n, forced, near=near) if n < len(group) else list(range(len(group)))
    return group.iloc[order].assign(rank=range(len(order)))[["entry", "row", "rank"]]


def projected_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(vec=list(projected(np.array(b["vec"].tolist(), np.float64)))) if len(b) else b


def held_distances(rows: DataFrame, held: DataFrame) -> DataFrame:
    """entry, row, near: the squared distance of each row to the nearest held one, where coresets measure it; null if nothing is held."""
    as_seen = lambda t: t.select("entry", "row", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(projected_batches, "entry bigint, row bigint, vec array<double>")
    found = nearest_mean(as_seen(rows), as_seen(held), 1, "none", ["entry", "row"])
    return found.select("entry", "row", (F.col("score") * F.col("score")).alias("near"))


def coreset(rows: DataFrame, budget: Column, forced: Column | None = None, near: Column | None = None) -> DataFrame:
    """The columns of `rows` (entry, row, vec, ...) and rank, for each entry's chosen rows. near: squared distance to rows held already. One image is one group, and bounded."""
    put = rows.select("entry", "row", "vec", budget.alias("budget"), F.coalesce(forced if forced is not None else F.lit(False), F.lit(False)).alias("forced"), (near if near is not None else F.lit(None)).cast("double").alias("near"))
    kept = put.groupBy("entry").applyInPandas(lambda g: reduced_rows(g), T.StructType([rows.schema["entry"], rows.schema["row"], T.StructField("rank", T.IntegerType())]))
    return rows.join(kept, ["entry", "row"])


def tiled(index: DataFrame, rows: DataFrame) -> None:
    """Raises unless the images' ranges (tier, label, entry, start, count) follow each other without gaps and cover each label's rows: else rows exist that no image claims."""
    put = totals_before(index.select("tier", "label", "entry", "start", "count"), "start", {"expected": F.col("count")}, ("tier", "label"))
    gaps = put.where("start <> expected").select("tier", "label").distinct()
    covered = index.groupBy("tier", "label").agg(F.sum("count").alias("covered"))
    there = rows.groupBy("tier", "label").agg(F.count("*").alias("there"))
    uneven = covered.join(there, ["tier", "label"], "full").where(~F.col("covered").eqNullSafe(F.col("there"))).select("tier", "label")
    repeated = index.groupBy("tier", "label", "start").count().where("count > 1").select("tier", "label")
    wrong = gaps.unionByName(uneven).unionByName(repeated).distinct().limit(5).collect()
    if wrong:
        raise ValueError(f"the index doesn't tile the rows of {[f'{r.tier}/{r.label}' for r in wrong]}")


def capped(rows: DataFrame, cap: int, held: DataFrame | None = None, marked: Column | None = None) -> DataFrame:
    """Images with at most `cap` rows each: marked rows first and always, then a coreset, in the order of choice.

    rows: entry, row (from 0), vec, and place (its place in the image's grid) if the image was
    reduced before. Returned: the columns with row numbered anew, place, and `reduced`. With `held`
    (entry, row, vec) the choice starts from the rows that are there already.
    """
    place = F.coalesce("place", "row") if "place" in rows.columns else F.col("row")
    mark = F.coalesce(marked if marked is not None else F.lit(False), F.lit(False))
    sized = rows.withColumns({"__place": place.cast("bigint"), "__mark": mark})
    if cap <= 0:
        return sized.drop("__mark", "place").withColumnRenamed("__place", "place").withColumn("reduced", F.lit(False))
    sizes = rows.groupBy("entry").agg(F.count("*").alias("__n"))
    sized = materialise(sized.join(sizes, "entry"), "sized")
    large, near = sized.where(F.col("__n") > cap), None
    if held is not None:
        large, near = large.join(held_distances(large, held), ["entry", "row"]), F.col("near")
    chosen = coreset(large, F.lit(cap), F.col("__mark"), near).drop("near").withColumn("row", F.col("rank").cast(rows.schema["row"].dataType)).drop("rank").withColumn("reduced", F.lit(True))
    out = chosen.unionByName(sized.where(F.col("__n") <= cap).withColumn("reduced", F.lit(False)))
    return out.drop("__n", "__mark", "place").withColumnRenamed("__place", "place")


def image_index(rows: DataFrame) -> DataFrame:
    """tier, label, entry, start, count, kept: each image's range of rows, and its rows' grid places where it was reduced (now or before). rows: tier, label, entry, row, place, reduced."""
    own = rows.groupBy("tier", "label", "entry").agg(F.array_sort(F.collect_list(F.struct("row", "place"))).alias("p"), F.max("reduced").alias("reduced"), F.max(F.col("row") != F.col("place")).alias("moved"))
    kept = own.select("tier", "label", "entry", F.when(F.col("reduced") | F.col("moved"), F.transform("p", lambda x: x["place"])).alias("kept"))
    return row_starts(rows).join(kept, ["tier", "label", "entry"])


def appended(bank: DataFrame, rows: DataFrame, now: int, cap: int = 0, start_from_held: bool = False) -> DataFrame:
    """The bank with new images of at most `cap` rows each. bank and rows: tier, label, entry, row, vec (and place); entries of `rows` are new.

    With `start_from_held` a new image's rows are chosen for what they add to the rows that the bank
    holds in all tiers, in the order of what they add.
    """
    new = capped(rows, cap, bank if start_from_held else None).drop("reduced")
    held = bank if "place" in bank.columns else bank.withColumn("place", F.col("row").cast("bigint"))
    return append(held, new, now)


def reduced_bank(bank: DataFrame, index: DataFrame, cap: int) -> DataFrame:
    """The bank with at most `cap` rows in each image of the labelled tiers; rows with another than the default severity stay, and come first. index: tier, label, entry, start, count of the labelled tiers. Raises if it doesn't tile the rows."""
    labelled = bank.where("tier <> 'normal'")
    tiled(index, labelled)
    out = capped(labelled, cap, marked=F.col("severity") != DEFAULT_SEVERITY).drop("reduced")
    normal = bank.where("tier = 'normal'")
    return out.unionByName(normal if "place" in bank.columns else normal.withColumn("place", F.col("row").cast("bigint")))


def rows_for_marks(images: DataFrame) -> DataFrame:
    """entry, row: stored rows that the marks (grid places) of each image point at. images: entry, rows, kept (null: all), marks."""
    marks = images.select("entry", "rows", F.explode("marks").alias("mark"), F.col("kept").isNull().alias("whole"))
    places = images.where("kept is not null").select("entry", F.posexplode("kept").alias("row", "mark"))
    direct = marks.where("whole and mark >= 0 and mark < rows").select("entry", F.col("mark").alias("row"))
    return direct.unionByName(marks.where("not whole").join(places, ["entry", "mark"]).select("entry", "row")).distinct()


def composed_kept(kept: Column, chosen: Column) -> Column:
    """Grid places of rows chosen among stored ones; null when all of the grid is there."""
    return F.when(chosen.isNull(), kept).when(kept.isNull(), chosen).otherwise(F.transform(chosen, lambda i: F.element_at(kept, i + 1)))


def assemble(images: DataFrame, assignments: DataFrame, features: DataFrame, ceiling: int, now: int, previous: DataFrame | None = None) -> DataFrame:
    """The bank's rows. images: entry, name, rows, kept; assignments: entry, tier, label, severity, marks; features: entry, row, vec."""
    from patchlake.operators.memory import carried_over

    missing = images.join(features.select("entry").distinct(), "entry", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"images without rows: {[r['entry'] for r in missing.select('entry').limit(5).collect()]}")
    placed = assigned(images, assignments)
    share = budgets(placed.select("tier", "entry", "rows"), ceiling, ("tier",)).select("entry", "budget")
    heavy = rows_for_marks(placed.where("tier <> 'normal'").select("entry", "rows", "kept", "marks")).withColumn("marked", F.lit(True))
    rows = features.join(placed.select("entry", "name", "tier", "label", "severity"), "entry").join(share, "entry").join(heavy, ["entry", "row"], "left")
    chosen = coreset(rows, F.col("budget"))
    out = chosen.withColumn("severity", F.when(F.col("marked"), 3).otherwise(F.col("severity")))
    out = with_defaults(out, now).select("tier", "label", "entry", "name", "row", "vec", "severity", "registered_at", "last_hit", "hit_count", "memory")
    return out if previous is None else carried_over(out, previous)


def assembly_status(images: DataFrame, assignments: DataFrame) -> DataFrame:
    """live, assigned, unassigned images and assignments without an image."""
    both = images.select("entry", F.lit(1).alias("i")).distinct().join(assignments.select("entry", F.lit(1).alias("a")).distinct(), "entry", "full")
    return both.agg(F.count("i").alias("live"), F.count_if(F.col("i").isNotNull() & F.col("a").isNotNull()).alias("assigned"), F.count_if(F.col("a").isNull()).alias("unassigned"), F.count_if(F.col("i").isNull()).alias("stale"))


def base_severity(bank: DataFrame) -> DataFrame:
    """tier, label, entry, severity, marks: the rows' commonest severity but heavy (smallest of equals), heavy rows as marks; heavy, without marks, if all are."""
    counted = bank.groupBy("tier", "label", "entry", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("row")).alias("rows"))
    rest = F.col("severity") != 3
    common = F.min_by(F.when(rest, F.col("severity")), F.when(rest, F.struct((-F.col("n")).alias("n"), "severity")))
    out = counted.groupBy("tier", "label", "entry").agg(common.alias("common"), F.max(F.when(~rest, F.col("rows"))).alias("heavy"))
    return out.select("tier", "label", "entry", F.coalesce("common", F.lit(3)).alias("severity"), F.when(F.col("common").isNull(), F.array().cast("array<int>")).otherwise(F.coalesce(F.col("heavy").cast("array<int>"), F.array().cast("array<int>"))).alias("marks"))


def fingerprint(images: DataFrame, assignments: DataFrame) -> DataFrame:
    """One digest of what would change the assembled bank: images with their rows, and assignments with severity and marks."""
    line = F.concat_ws(":", F.lit("i"), F.col("entry").cast("string"), F.col("rows").cast("string"))
    marks = F.array_join(F.transform("marks", lambda m: m.cast("string")), ",")
    given = F.concat_ws(":", F.lit("a"), F.col("entry").cast("string"), "tier", safe_label(F.col("label")), clamped_severity(F.col("severity")).cast("string"), marks)
    both = images.select(line.alias("x")).unionByName(assignments.select(given.alias("x")))
    return sums_of(both, F.col("x")).select(digest(32).alias("fingerprint"))


def membership(bank: DataFrame, marked: bool = False) -> DataFrame:
    """tier, label, entry, line: an image's place in the bank as text; with `marked` the rows that are marked as heavy too."""
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == 3, F.col("row")))), lambda r: r.cast("string")), ",") if marked else F.lit("")
    images = bank.groupBy("tier", "label", "entry").agg(F.count("*").alias("n"), (F.when(F.first("tier") == "normal", "").otherwise(marks) if marked else marks).alias("marks"))
    return images.select("tier", "label", "entry", F.concat_ws(":", "tier", "label", F.col("entry").cast("string"), F.col("n").cast("string"), "marks").alias("line"))


def bank_digests(bank: DataFrame, settings: str = "") -> DataFrame:
    """One row: `evaluation` changes with what scores depend on (the normal images and the settings of the search), `content` with every image and heavy mark too. bank: tier, label, entry, row, severity."""
    lines = membership(bank, True)
    out = lines.withColumn("evaluation", F.when(F.col("tier") == "normal", F.col("line")))
    sums = {**{f"e_{n}": c for n, c in row_sums(F.col("evaluation")).items()}, **{f"c_{n}": c for n, c in row_sums(F.col("line")).items()}}
    both = out.agg(*[c.alias(n) for n, c in sums.items()])
    named = lambda which: F.sha2(F.concat_ws(",", F.lit(settings), *[F.col(f"{which}_{n}").cast("string") for n in SUMS]), 256)
    return both.select(named("e").alias("evaluation"), named("c").alias("content"))


def bank_diff(one: DataFrame, other: DataFrame) -> DataFrame:
    """tier, label and how many rows are only in one, only in the other, or differ in vector or severity; only labels that differ."""
    key = ["tier", "label", "entry", "row"]
    a, b = (t.select(*key, F.struct("vec", "severity").alias(n)) for t, n in ((one, "a"), (other, "b")))
    both = a.join(b, key, "full").groupBy("tier", "label")
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = both.agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(known & (F.col("a.vec") != F.col("b.vec"))).alias("vectors"), F.count_if(known & (F.col("a.severity") != F.col("b.severity"))).alias("severities"))
    return out.where("only_first + only_second + vectors + severities > 0")


def taught(arrivals: DataFrame, held: int, ceiling: int, cap: int) -> DataFrame:
    """arrivals (position, rows) with taken: each image's rows, at most `cap`, until the ceiling; the image that crosses it is cut, later ones get none."""
    wanted = arrivals.withColumn("__want", F.least("rows", F.lit(cap)) if cap > 0 else F.col("rows"))
    before = totals_before(wanted, "position", {"__before": F.col("__want")})
    room = F.greatest(F.lit(0), F.lit(ceiling - held) - F.col("__before"))
    return before.select(*arrivals.columns, F.least("__want", room).cast("bigint").alias("taken"))


def half_precision(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(**{column: [np.asarray(v, np.float16).astype(np.float32) for v in b[column]]})


def as_half(rows: DataFrame, column: str = "vec") -> DataFrame:
    """Vectors rounded to half precision."""
    return rows.mapInPandas(partial(half_precision, column=column), rows.schema)
