"""Queries of nearest-row search: full, routed, with rows left out, by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.scoring import multiplier
from patchlake.operators.clusters import assign
from patchlake.operators.evaluation import attribution, image_topk_mean, label_winners
from patchlake.operators.knn import dealt, label_nearest, nearest_mean
from patchlake.operators.lists import listed, searched_mean
from patchlake.plans.binding import LABELS_SQL, NOW, ROWS_SQL, bank_rows, topk_sql
from patchlake.plans.registry import query

CENTROIDS_SQL = "centroids as (select (vec_id // 25)::int as cluster, vec as center from bank where vec_id % 25 = 0)"
ASSIGNED_SQL = """ranked as (select b.vec_id, c.cluster, list_distance(b.vec, c.center) as d, row_number() over (partition by b.vec_id order by round(list_distance(b.vec, c.center) ** 2, 12), c.cluster) as probe from bank b cross join centroids c)"""


def centroids(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 25 = 0").select(F.floor(F.col("vec_id") / 25).cast("int").alias("cluster"), F.col("vec").alias("center"))


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.round("score", 6).alias("score"))


@query(f"with {ROWS_SQL}, {topk_sql('q.vec_id <> b.vec_id', rows='true')} select vec_id, round(score, 6) as score from scored")
def o44_nearest_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against all others."""
    rows = bank_rows(spark, sf_dir).withColumn("entry", F.col("vec_id"))
    return rounded(nearest_mean(rows, rows, 5, "entry", ["vec_id"]), "vec_id")


@query(f"""
with {ROWS_SQL}, {CENTROIDS_SQL}, {ASSIGNED_SQL},
near as (select a.vec_id, avg(d) as score from (
  select q.vec_id, list_distance(q.vec, b.vec) as d, row_number() over (partition by q.vec_id order by list_distance(q.vec, b.vec), b.vec_id) as r
  from bank q join ranked p on q.vec_id = p.vec_id and p.probe <= 3 join ranked o on o.cluster = p.cluster and o.probe = 1 join bank b on b.vec_id = o.vec_id where q.entry <> b.entry) a where r <= 5 group by 1),
{topk_sql('q.entry <> b.entry', rows='true')}
select s.vec_id, round(coalesce(n.score, s.score), 6) as score from scored s left join near n on s.vec_id = n.vec_id""")
def o45_routed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    centers = centroids(rows)
    index = listed(assign(dealt(rows.select("entry", "row", "vec")), centers), centers)
    found = searched_mean(rows.select(F.col("vec_id").alias("id"), "entry", "vec"), index, 5, 3, "entry")
    return rounded(found.withColumnRenamed("id", "vec_id"), "vec_id")


@query(f"with {ROWS_SQL}, {topk_sql('q.entry <> b.entry')} select vec_id, round(score, 6) as score from scored")
def o46_leave_own_image_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    return rounded(nearest_mean(rows, rows.where("tier = 'normal'"), 5, "entry", ["vec_id"]), "vec_id")


@query(f"with {ROWS_SQL}, {topk_sql('q.entry <> b.entry and q.grp <> b.grp')} select vec_id, round(score, 6) as score from scored")
def o47_leave_own_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    return rounded(nearest_mean(rows, rows.where("tier = 'normal'"), 5, "group", ["vec_id"]), "vec_id")


def weighted_nearest(rows: DataFrame) -> DataFrame:
    """vec_id, entry, row, tier, label, distance, nearest for both labelled tiers."""
    weight = multiplier(F.col("severity"), F.lit(NOW), F.col("last_hit"), F.col("memory"))
    bank = rows.where("tier <> 'normal'").select("entry", "row", F.col("vec_id").alias("id"), F.concat_ws("/", "tier", "label").alias("label"), "vec", weight.alias("weight"))
    found = label_nearest(rows.select("vec_id", "entry", "row", "vec"), bank, "entry", weighted=True)
    return found.select("vec_id", "entry", "row", F.split("label", "/")[0].alias("tier"), F.split("label", "/")[1].alias("label"), "distance", "nearest")


@query(f"with {ROWS_SQL}, {LABELS_SQL} select vec_id, tier, label, round(distance, 5) as distance, nearest from best")
def o49_label_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_nearest(bank_rows(spark, sf_dir)).select("vec_id", "tier", "label", F.round("distance", 5).alias("distance"), "nearest")


@query(f"with {ROWS_SQL}, {CENTROIDS_SQL}, {ASSIGNED_SQL} select vec_id, cluster from ranked where probe = 1")
def o58_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    return assign(dealt(rows.select("vec_id", "vec")), centroids(rows)).select("vec_id", "cluster")


@query(f"with {ROWS_SQL}, {topk_sql('q.entry <> b.entry', k=10, rows='vec_id < 35')} select vec_id, round(score, 6) as score from scored")
def o61_few_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k above what is left: the mean is over those there are."""
    rows = bank_rows(spark, sf_dir)
    return rounded(nearest_mean(rows, rows.where("vec_id < 35"), 10, "entry", ["vec_id"]), "vec_id")


@query(f"""with {ROWS_SQL}, {topk_sql('q.entry <> b.entry')}
select entry, round(avg(score), 6) as topk from (select *, row_number() over (partition by entry order by score desc, row) as r from scored) where r <= 3 group by 1""")
def o62_image_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    scores = nearest_mean(rows, rows.where("tier = 'normal'"), 5, "entry", ["entry", "row"])
    return image_topk_mean(scores, ("entry",), "row", 3).select("entry", F.round("topk", 6).alias("topk"))


@query(f"with {ROWS_SQL}, {LABELS_SQL} select vec_id, tier, round(min(distance), 5) as distance from best group by 1, 2")
def o65_least_over_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_nearest(bank_rows(spark, sf_dir)).groupBy("vec_id", "tier").agg(F.round(F.min("distance"), 5).alias("distance"))


@query(f"""with {ROWS_SQL}, {LABELS_SQL}, w as (select entry, tier, label, arg_min(distance, (distance, row)) as distance, arg_min(nearest, (distance, row)) as nearest from best group by all)
select entry, tier, label, round(distance, 5) as distance, nearest, round(case tier when 'critical' then 20.0 else 1.0 end / (1 + distance), 6) as attribution from w""")
def o66_o67_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = label_winners(weighted_nearest(bank_rows(spark, sf_dir)), ("entry", "tier"))
    return attribution(won, 20.0, 0.0).select("entry", "tier", "label", F.round("distance", 5).alias("distance"), "nearest", F.round("attribution", 6).alias("attribution"))
