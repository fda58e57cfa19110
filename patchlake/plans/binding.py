"""The domain's tables as views of the given ones, for Spark and, as text, for SQL.

Rows of a bank come from `embeddings`: ten to an entry, entries dealt to the
tiers normal, critical and negative, three entries to a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.sources.shared import table

NOW = 1000
#: Rows that a tier may hold in the queries with a ceiling.
CEILING = 60

ROWS_SQL = """bank as (
  select vec_id, vec_id // 10 as entry, vec_id % 10 as row, case (vec_id // 10) % 5 when 3 then 'critical' when 4 then 'negative' else 'normal' end as tier,
    case when (vec_id // 10) % 5 >= 3 then 'd' || ((vec_id // 10) % 3) else '' end as label, 'g' || (vec_id // 30) as grp, embedding::DOUBLE[] as vec,
    1 + vec_id % 3 as severity, vec_id as last_hit, vec_id % 13 as hit_count, vec_id % 3 as memory
  from embeddings)"""


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    v, entry = F.col("vec_id"), F.floor(F.col("vec_id") / 10)
    labelled = entry % 5 >= 3
    return t.select(
        "vec_id", entry.alias("entry"), (v % 10).alias("row"),
        F.when(entry % 5 == 3, "critical").when(entry % 5 == 4, "negative").otherwise("normal").alias("tier"),
        F.when(labelled, F.concat(F.lit("d"), entry % 3)).otherwise("").alias("label"),
        F.concat(F.lit("g"), F.floor(v / 30)).alias("grp"), F.col("embedding").cast("array<double>").alias("vec"),
        (1 + v % 3).alias("severity"), v.alias("last_hit"), (v % 13).alias("hit_count"), (v % 3).alias("memory"),
    )


def topk_sql(condition: str, k: int = 5, queries: str = "true", rows: str = "tier = 'normal'", name: str = "scored") -> str:
    """SQL for the mean distance of each query row to its k nearest bank rows."""
    return f"""{name} as (
  select vec_id, entry, row, tier, avg(d) as score from (
    select q.vec_id, q.entry, q.row, q.tier, list_distance(q.vec, b.vec) as d, row_number() over (partition by q.vec_id order by list_distance(q.vec, b.vec)) as r
    from (select * from bank where {queries}) q join (select * from bank where {rows}) b on {condition})
  where r <= {k} group by all)"""


def evals_sql() -> str:
    """bank, scored and evals: each image's statistics and its scores from the largest."""
    return f"""{ROWS_SQL},
{topk_sql("q.entry <> b.entry")},
evals as (
  select entry, tier, count(*) as patches, max(score) as score_max, avg(score) as score_mean, quantile_cont(score, 0.99) as score_p99,
    list(score order by score desc, row) as top from scored group by entry, tier)"""


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, assignments and features of the bank's entries."""
    rows = bank_rows(spark, sf_dir)
    per_image = rows.groupBy("entry").agg(F.count("*").alias("rows"), F.first("tier").alias("tier"), F.first("label").alias("label"))
    images = per_image.select("entry", F.concat(F.lit("image"), "entry").alias("name"), "rows", F.lit(None).cast("array<int>").alias("kept"))
    marks = F.array(F.lit(0), (F.col("entry") % 5).cast("int"), F.lit(99))
    given = per_image.where("entry % 7 <> 0").select("entry", "tier", "label", (1 + F.col("entry") % 3).cast("int").alias("severity"), marks.alias("marks"))
    return images, given, rows.select("entry", "row", "vec")


#: The nearest row of each label for each row, weighted and without rows of its own entry.
LABELS_SQL = f"""near as (
  select q.vec_id, q.entry, q.row, b.tier, b.label, list_distance(q.vec, b.vec) / (b.severity / 2.0 * exp(-greatest({NOW} - b.last_hit, 0) / [100.0, 1000.0, 10000.0][b.memory + 1]) + 1e-6) as d, b.vec_id as nearest
  from bank q join bank b on q.entry <> b.entry where b.tier <> 'normal'),
best as (select vec_id, entry, row, tier, label, min(d) as distance, arg_min(nearest, d) as nearest from near group by all)"""


#: File names made from `events`.
FILE_NAME_SQL = "case event_id % 5 when 0 then 'OK_' || strftime(ts, '%y%m%d_%H%M%S') || '_cam1.png' when 1 then 'lot/' || strftime(ts, '%Y-%m-%d') || '__x (1).JPG' when 2 then 'OK_0002-08-02-' || event_id || '.jpg' when 3 then strftime(ts, '%Y%m%d') || '.' || user_id || '.tif' else 'a_b_' || user_id end"


def file_name() -> Column:
    kind, user, event = F.col("event_id") % 5, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    return (
        F.when(kind == 0, F.concat(F.lit("OK_"), F.date_format("ts", "yyMMdd_HHmmss"), F.lit("_cam1.png")))
        .when(kind == 1, F.concat(F.lit("lot/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("__x (1).JPG")))
        .when(kind == 2, F.concat(F.lit("OK_0002-08-02-"), event, F.lit(".jpg")))
        .when(kind == 3, F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("."), user, F.lit(".tif")))
        .otherwise(F.concat(F.lit("a_b_"), user))
    )
