"""Queries of image statistics and separation: statistics, AUROC, thresholds, sweeps, histograms, scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.scoring import mean_of_first, patch_floor, stat_with_alpha, verdict
from patchlake.operators import evaluation as e
from patchlake.operators.knn import nearest_mean
from patchlake.operators.projection import robust_scale
from patchlake.plans.binding import ROWS_SQL, bank_rows, evals_sql, topk_sql
from patchlake.plans.registry import query
from patchlake.sources.shared import materialise, table


def scored_rows(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """Every row's leave-own-image-out score against the normal rows, or that of the rows asked for: a condition on the scores would come after the search of all."""
    rows = bank_rows(spark, sf_dir)
    return nearest_mean(rows.where(which), rows.where("tier = 'normal'"), 5, "entry", ["entry", "row", "tier"])


def evals(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """entry, tier, patches, score_max, score_mean, score_p99, top (scores only)."""
    found = e.image_eval(materialise(scored_rows(spark, sf_dir, which), "scored"), ("entry", "tier"))
    return materialise(found.withColumn("top", F.transform("top", lambda x: x["score"])), "evals")


@query(f"""with {evals_sql()}
select entry, tier, patches, round(score_max, 6) as score_max, round(score_mean, 6) as score_mean, round(score_p99, 6) as score_p99, round(top[1], 6) as top1, round(list_sum(top[:3]) / least(3, len(top)), 6) as top3, len(top)::int as n_top from evals""")
def o68_image_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-own-image-out statistics of every image against the normal rows."""
    t = evals(spark, sf_dir)
    return t.select("entry", "tier", "patches", *[F.round(c, 6).alias(c) for c in ("score_max", "score_mean", "score_p99")], F.round(F.get("top", 0), 6).alias("top1"), F.round(mean_of_first(F.col("top"), 3), 6).alias("top3"), F.size("top").alias("n_top"))


@query(f"""with {ROWS_SQL}, {topk_sql('true', queries="tier = 'critical'")}
select entry, round(max(score), 6) as score_max, round(avg(score), 6) as score_mean, round(quantile_cont(score, 0.99), 6) as score_p99 from scored group by 1""")
def o69_score_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    scored = nearest_mean(rows.where("tier = 'critical'"), rows.where("tier = 'normal'"), 5, keep=["entry", "row"])
    return e.image_stats(scored).select("entry", *[F.round(c, 6).alias(c) for c in ("score_max", "score_mean", "score_p99")])


TRUTH_SQL = "truth as (select n_chars::double as v, quality = 0 as positive from labels join documents using (doc_id))"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(F.col("n_chars").cast("double").alias("v"), (F.col("quality") == 0).alias("positive"))


@query(f"""with {TRUTH_SQL}, r as (select positive, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from truth),
s as (select sum(r) filter (positive) as u, count(*) filter (positive) as p, count(*) filter (not positive) as n from r)
select round((u - p * (p + 1) / 2.0) / (p::double * n), 9) as auroc from s""")
def o70_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.auroc(truth(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"))


YOUDEN_SQL = """with d as (select value as v, count(*) filter (event_type = 'error') as p, count(*) filter (event_type <> 'error') as n from events group by 1),
w as (select v, p + n as rows, lead(v) over (order by v) as following, 1 - sum(p) over (order by v) / sum(p) over ()::double - (1 - sum(n) over (order by v) / sum(n) over ()::double) as j from d),
c as (select v as m, v, j, 0 as place from w where rows > 1 union all select (v + following) / 2, v, j, 1 from w where following is not null)
select round(arg_max(m, (round(j, 12), -v, -place)), 6) as threshold, round(arg_max(j, (round(j, 12), -v, -place)), 6) as j from c"""


@query(YOUDEN_SQL)
def o71_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("v"), (F.col("event_type") == "error").alias("positive"))
    return e.youden(rows).select(F.round("threshold", 6).alias("threshold"), F.round("j", 6).alias("j"))


@query(YOUDEN_SQL)
def o71_youden_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older name of `o71_youden`."""
    return o71_youden(spark, sf_dir)


def auroc_sql(keys: str, rows: str) -> str:
    return f"""ranks as (select {keys}, positive, rank() over (partition by {keys} order by v) + (count(*) over (partition by {keys}, v) - 1) / 2.0 as r from {rows}),
sums as (select {keys}, sum(r) filter (positive) as u, count(*) filter (positive) as p, count(*) filter (not positive) as n from ranks group by all),
aurocs as (select {keys}, (u - p * (p + 1) / 2.0) / (p::double * n) as auroc from sums)"""


@query(f"""with {evals_sql()}, swept as (select k, tier = 'critical' as positive, round(list_sum(top[:k]) / least(k, len(top)), 9) as v from evals, unnest(range(1, 257)) as t(k) where tier <> 'negative'),
{auroc_sql('k', 'swept')}
select arg_max(k, (round(auroc, 12), -k))::int as k, round(max(auroc), 9) as auroc from aurocs""")
def o72_best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evals(spark, sf_dir).where("tier <> 'negative'").select((F.col("tier") == "critical").alias("positive"), "top")
    return e.best_k(t, rounded=9).select("k", F.round("auroc", 9).alias("auroc"))


#: A stand-in for distances to exemplars: as long as the top list, from the rank and the image.
CMIN_SQL = "list_transform(range(1, len(top) + 1), lambda i: 0.1 + ((i * 7 + entry) % 13) / 10.0)"


def with_cmin(t: DataFrame) -> DataFrame:
    return t.withColumn("cmin", F.transform("top", lambda x, i: 0.1 + (((i + 1) * 7 + F.col("entry")) % 13) / 10.0))


STAT_SQL = "list_sum(list_reverse_sort(list_transform(range(1, len(top) + 1), lambda i: top[i] + a / (1 + cmin[i])))[:5]) / least(5, len(top))"


@query(f"""with {evals_sql()}, c as (select *, {CMIN_SQL} as cmin from evals where tier <> 'negative'), swept as (select a, tier = 'critical' as positive, round({STAT_SQL}, 9) as v from c, unnest(range(0, 201, 5)) as t(a)),
{auroc_sql('a', 'swept')},
e as (select a, min(v) as lo, max(v) as hi, min(v) filter (positive) as ng, max(v) filter (not positive) as ok from swept group by 1)
select a::int as alpha, round(auroc, 9) as auroc, round((ng - ok) / (hi - lo), 6) as margin from aurocs join e using (a)""")
def o73_alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = e.alpha_sweep(with_cmin(evals(spark, sf_dir)), "topk", 5, digits=9)
    return swept.select("alpha", F.round("auroc", 9).alias("auroc"), F.round("margin", 6).alias("margin"))


@query(f"""with {evals_sql()}, c as (select *, {CMIN_SQL} as cmin, 20 as a from evals)
select entry, round({STAT_SQL}, 6) as topk, round(list_reverse_sort(list_transform(range(1, len(top) + 1), lambda i: top[i] + a / (1 + cmin[i])))[least(len(top) - 1, floor(patches * 0.01 + 0.5))::int + 1], 6) as p99, round(score_p99, 6) as raw_p99 from c""")
def o74_stat_with_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_cmin(evals(spark, sf_dir))
    args = [F.col(c) for c in ("top", "cmin", "patches", "score_p99", "score_max")]
    return t.select("entry", *[F.round(stat_with_alpha(*args, kind, 5, a), 6).alias(n) for n, kind, a in (("topk", "topk", 20.0), ("p99", "p99", 20.0), ("raw_p99", "p99", 0.0))])


@query(f"""with {evals_sql()}, c as (select *, {CMIN_SQL} as cmin from evals where tier = 'normal'),
f as (select list_min(list_transform(range(1, len(top) + 1), lambda i: top[i] + 20 / (1 + cmin[i]))) as v from c)
select round(list_sort(list(v))[count(*) // 2 + 1], 6) as ok_floor from f""")
def o75_patch_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_cmin(evals(spark, sf_dir, "tier = 'normal'"))
    floors = t.select(patch_floor(F.col("top"), F.col("cmin"), F.col("score_mean"), 20.0).alias("ok_floor"))
    return e.upper_median(floors, "ok_floor").select(F.round("ok_floor", 6).alias("ok_floor"))


VALUES_SQL = "v as (select case event_type when 'error' then 'critical' when 'click' then 'negative' else 'normal' end as tier, value as v from events)"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "negative").otherwise("normal")
    return table(spark, sf_dir, "events").select("event_id", tier.alias("tier"), F.col("value").alias("v"))


@query(f"""with {VALUES_SQL} select count(*) filter (tier = 'normal') as n_ok, count(*) filter (tier = 'critical') as n_ng, count(*) filter (tier = 'negative') as n_negative,
  count(*) filter (tier = 'critical' and v <= 20) as misses, count(*) filter (tier = 'normal' and v > 20) as false_alarms, 20.0::double as threshold from v""")
def o76_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, sf_dir)
    return e.separation(t, t.sparkSession.range(1).select(F.lit(20.0).alias("threshold")))


@query(f"""with {VALUES_SQL}, e as (select min(v) as lo, max(v) - min(v) as span from v), b as (select least(47, greatest(0, floor((v - lo) / span * 48)))::int as bin, tier from v, e)
select i::int as bin, count(*) filter (tier = 'normal') as normal, count(*) filter (tier = 'critical') as critical, count(*) filter (tier = 'negative') as negative from range(48) t(i) left join b on bin = i group by 1""")
def o77_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.histogram(values(spark, sf_dir))


@query(f"with {VALUES_SQL} select tier, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as spread, list_sort(list(v))[count(*) // 2 + 1] as middle from v group by 1")
def o38_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, sf_dir)
    each = t.groupBy("tier").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("spread"))
    return each.join(e.upper_median(t, "v", ("tier",)).withColumnRenamed("v", "middle"), "tier")


@query(f"with {VALUES_SQL}, s as (select list_sort(list(v)) as s, count(*) as n from v) select s[floor(n * 0.05)::bigint + 1] as lo, s[least(n - 1, floor(n * 0.95)::bigint) + 1] as hi from s")
def o94_robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_scale(values(spark, sf_dir), "v")


@query(f"with {VALUES_SQL} select tier, case tier when 'normal' then case when v > 20 then 'fp' else 'ok' end when 'critical' then case when v > 20 then 'ng' else 'miss' end else 'neg' end as kind, count(*) as images from v group by all")
def o155_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, sf_dir).withColumn("kind", verdict(F.col("tier"), F.col("v"), F.lit(20.0)))
    return t.groupBy("tier", "kind").agg(F.count("*").alias("images"))


CELLS_SQL = "cells as (select l_orderkey as image, l_linenumber as gy, l_suppkey % 9 as gx, l_extendedprice as score from lineitem)"


@query(f"""with {CELLS_SQL}, m as (select image, gy, gx, max(score) as score from cells group by all), s as (select image, max(gy) + 1 as h, max(gx) + 1 as w from cells group by 1),
y as (select image, unnest(range(0, h)) as gy, w from s), f as (select image, gy, unnest(range(0, w)) as gx from y), a as (select image, avg(score) as mean from m group by 1)
select f.image, f.gy::int as gy, f.gx::bigint as gx, round(coalesce(m.score, a.mean), 6) as score from f left join m on f.image = m.image and f.gy = m.gy and f.gx = m.gx join a on a.image = f.image""")
def o63_grid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("gy"), (F.col("l_suppkey") % 9).alias("gx"), F.col("l_extendedprice").alias("score"))
    merged = e.grid_merge(cells, F.col("gy") + 1, F.col("gx") + 1)
    return merged.select("image", F.col("gy").cast("int").alias("gy"), F.col("gx").cast("bigint").alias("gx"), F.round("score", 6).alias("score"))


@query(f"""with {CELLS_SQL}, m as (select image, gy, gx, max(score) as score from cells group by all), s as (select image, max(gy) + 1 as h, max(gx) + 1 as w from m group by 1),
f as (select image, h, w, gy, gx from s, range(12) a(gy), range(12) b(gx) where gy < h and gx < w), g as (select f.image, h, w, f.gy, f.gx, coalesce(score, 0) as score from f left join m on f.image = m.image and f.gy = m.gy and f.gx = m.gx),
p as (select image, h, w, y, x, greatest(0, least(h - 1, (y + 0.5) / 4 - 0.5)) as v, greatest(0, least(w - 1, (x + 0.5) / 4 - 0.5)) as u from s, range(48) a(y), range(48) b(x) where y < h * 4 - 3 and x < w * 4 + 5)
select p.image, p.y::int as y, round(sum(score * greatest(0, 1 - abs(v - gy)) * greatest(0, 1 - abs(u - gx))), 8) as total from p join g on p.image = g.image and abs(v - gy) < 1 and abs(u - gx) < 1 group by 1, 2""")
def o64_grid_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat maps of four pixels to a cell; each row's total."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("gy"), (F.col("l_suppkey") % 9).alias("gx"), F.col("l_extendedprice").alias("score"))
    cells = e.by_image(t).groupBy("image", "gy", "gx").agg(F.max("score").alias("score"))
    sizes = cells.groupBy("image").agg(((F.max("gy") + 1) * 4 - 3).alias("height"), ((F.max("gx") + 1) * 4 + 5).alias("width"))
    pixels = e.grid_to_pixels(cells.join(sizes, "image"), 4)
    return pixels.select("image", "y", F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 8).alias("total"))
