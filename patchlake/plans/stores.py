"""Queries of the image store and label sets: listing, assignment, status, marks, edits, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.operators import assembly as a
from patchlake.operators import catalog as c
from patchlake.operators.exemplars import live_evaluations, newest, orphaned_evaluations
from patchlake.plans.registry import query
from patchlake.sources.shared import table

#: Images are documents; those with labels are assigned, some of them to no known tier.
STORE_SQL = """images as (select doc_id as entry, source as name, (n_chars % 97)::bigint as rows from documents),
assignments as (select doc_id as entry, case when toxic = 1 then 'critical' when doc_id % 11 = 0 then 'other' when quality = 0 then 'negative' else 'normal' end as tier, 'Kind ' || (doc_id % 4) as label, (doc_id % 5)::bigint as severity from labels
  union all select 900000000 + doc_id, 'critical', 'gone', 1 from labels where doc_id % 50 = 0)"""
LABEL_SQL = "case when tier = 'normal' then '' else 'kind_' || right(label, 1) || '-' || left(sha256(label), 8) end"


def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry"), F.col("source").alias("name"), (F.col("n_chars") % 97).alias("rows"))
    labels = table(spark, sf_dir, "labels")
    tier = F.when(F.col("toxic") == 1, "critical").when(F.col("doc_id") % 11 == 0, "other").when(F.col("quality") == 0, "negative").otherwise("normal")
    given = labels.select(F.col("doc_id").alias("entry"), tier.alias("tier"), F.concat(F.lit("Kind "), (F.col("doc_id") % 4).cast("string")).alias("label"), (F.col("doc_id") % 5).alias("severity"))
    stale = labels.where("doc_id % 50 = 0").select((F.lit(900000000) + F.col("doc_id")).alias("entry"), F.lit("critical").alias("tier"), F.lit("gone").alias("label"), F.lit(1).cast("bigint").alias("severity"))
    return images, given.unionByName(stale)


@query(f"with {STORE_SQL} select entry, rows from images where entry not in (select entry from assignments where tier <> 'normal')")
def o6_missing_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, assignments = store(spark, sf_dir)
    return c.missing_arrays(images, assignments.where("tier <> 'normal'")).select("entry", "rows")


@query(f"with {STORE_SQL} select i.entry, tier, {LABEL_SQL} as label, greatest(1, least(3, severity))::bigint as severity, rows from images i join assignments a on i.entry = a.entry where tier in ('normal', 'critical', 'negative')")
def o50_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.assigned(*store(spark, sf_dir))
    return out.select("entry", "tier", "label", F.col("severity").cast("bigint").alias("severity"), "rows")


@query(f"with {STORE_SQL} select count(i.entry) as live, count(i.entry) filter (a.entry is not null) as assigned, count(*) filter (a.entry is null) as unassigned, count(*) filter (i.entry is null) as stale from images i full join assignments a on i.entry = a.entry")
def o79_assembly_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.assembly_status(*store(spark, sf_dir))


@query(f"with {STORE_SQL} select i.entry, coalesce(tier, '') as tier, case when tier = 'normal' then '' else coalesce(label, '') end as label, coalesce(severity, 0) as severity from images i left join assignments a on i.entry = a.entry")
def o125_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.listing(*store(spark, sf_dir)).select("entry", "tier", "label", F.col("severity").cast("bigint").alias("severity"))


@query(f"with {STORE_SQL}, l as (select coalesce(tier, '') as tier from images i left join assignments a on i.entry = a.entry) select t as tier, count(l.tier) as images from (select unnest(['', 'normal', 'critical', 'negative']) as t) left join l on t = tier group by 1")
def o153_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.tier_counts(c.listing(*store(spark, sf_dir)))


@query(f"with {STORE_SQL} select label, count(*) as images, min(entry) as first from assignments where tier = 'critical' and label <> '' group by 1")
def o154_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.label_counts(store(spark, sf_dir)[1], "entry")


@query(f"with {STORE_SQL}, l as (select count(i.entry) as live, count(*) filter (a.entry is null) as unassigned from images i left join assignments a on i.entry = a.entry) select live > 0 as has_images, unassigned = 0 as labelled from l")
def o160_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.assembly_status(*store(spark, sf_dir)).select((F.col("live") > 0).alias("has_images"), (F.col("unassigned") == 0).alias("labelled"))


@query(f"with {STORE_SQL}, m as (select entry, unnest([entry % 5, (entry + 2) % 40, 90]) as mark, rows from images) select distinct entry, mark as row from m where mark < rows and entry % 2 = 0 union select entry, 0 as row from images where entry % 2 = 1 union select entry, 1 from images where entry % 2 = 1")
def o57_rows_for_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even images keep their whole grid; odd ones kept the places 90 and entry % 5."""
    images, e = store(spark, sf_dir)[0], F.col("entry")
    marks = F.array(e % 5, (e + 2) % 40, F.lit(90).cast("bigint"))
    return a.rows_for_marks(images.select("entry", "rows", marks.alias("marks"), F.when(e % 2 == 1, F.array(F.lit(90).cast("bigint"), e % 5)).alias("kept"))).select("entry", F.col("row").cast("bigint").alias("row"))


@query(f"with {STORE_SQL} select entry, case when entry % 3 = 0 then 'negative' else tier end as tier, case when entry % 3 = 0 then 'new' else label end as label from assignments where entry % 7 <> 1")
def o112_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some unassigned, some assigned anew."""
    given = store(spark, sf_dir)[1]
    changed = given.where("entry % 3 = 0").withColumns({"tier": F.lit("negative"), "label": F.lit("new")})
    return c.upsert(given, changed).where("entry % 7 <> 1").select("entry", "tier", "label")


@query(f"with {STORE_SQL} select 'images' as kind, count(*) as rows from images where entry % 10 <> 0 union all select 'assignments', count(*) from assignments where entry not in (select entry from images where entry % 10 = 0)")
def o113_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, given = store(spark, sf_dir)
    left, still = c.cascade_delete(images, given, images.where("entry % 10 = 0"))
    return left.agg(F.count("*").alias("rows")).select(F.lit("images").alias("kind"), "rows").unionByName(still.agg(F.count("*").alias("rows")).select(F.lit("assignments").alias("kind"), "rows"))


@query(f"with {STORE_SQL} select entry, tier, entry in (select entry from images) as live from assignments")
def o53_evaluation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, given = store(spark, sf_dir)
    live = live_evaluations(given, images, ("entry",)).select("entry", "tier", F.lit(True).alias("live"))
    return live.unionByName(orphaned_evaluations(given, images, ("entry",)).select("entry", "tier", F.lit(False).alias("live")))


@query("select event_id, ts, user_id from events order by ts desc, event_id desc limit 200")
def o14_inspection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), 200, ("ts", "event_id"))


@query("select count(*) as done, count(*) filter (event_type = 'error') as error, count(*) filter (event_type <> 'error' and value <= 20) as ok, count(*) filter (event_type <> 'error' and value > 20) as ng from events")
def o161_inspection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").agg(F.count("*").alias("done"), F.count_if(~fine).alias("error"), F.count_if(fine & (F.col("value") <= 20)).alias("ok"), F.count_if(fine & (F.col("value") > 20)).alias("ng"))


@query("select source as name, min(doc_id) as first from documents group by 1")
def o100_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.first_seen(table(spark, sf_dir, "documents").select(F.col("source").alias("name"), "doc_id"), "name", "doc_id")
