"""Queries of assembly, coresets, the built index, projection and parity: images are entries of the bank, every seventh one unassigned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlake.functions.digest import digest_sql
from patchlake.operators import assembly as a
from patchlake.operators import clusters as c
from patchlake.operators import lists, memory
from patchlake.operators import projection as p
from patchlake.operators.knn import nearest_mean
from patchlake.plans.binding import CEILING, NOW, ROWS_SQL, bank_rows, stored
from patchlake.plans.registry import query
from patchlake.sources.shared import materialise, scratch_path, table

K = 5


@query(f"""with {ROWS_SQL} select tier, label, entry, 'image' || entry as name, row,
case when tier <> 'normal' and row in (0, entry % 5) then 3 else 1 + entry % 3 end::int as severity, {NOW}::bigint as registered_at, {NOW}::bigint as last_hit, 0::bigint as hit_count, 0::int as memory
from bank where entry % 7 <> 0""")
def o110_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.assemble(*stored(spark, sf_dir), 0, NOW).drop("vec")


@query(f"with {ROWS_SQL} select tier, least(count(*), {CEILING})::bigint as rows, count(distinct entry) as images from bank where entry % 7 <> 0 group by tier")
def o109_coreset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.assemble(*stored(spark, sf_dir), CEILING, NOW).groupBy("tier").agg(F.count("*").alias("rows"), F.count_distinct("entry").alias("images"))


@query(f"""with {ROWS_SQL}, arrived as (select tier, label, entry + 1000000 as entry, row, severity from bank where tier <> 'normal')
select tier, label, entry, row, severity, last_hit, hit_count, memory from bank union all
select tier, label, entry, row, case when row % 2 = 0 then severity else 2 end, {NOW}, 0, 0 from arrived""")
def o101_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    columns = ["tier", "label", "entry", "row", "severity", "last_hit", "hit_count", "memory"]
    new = rows.where("tier <> 'normal'").select("tier", "label", (F.col("entry") + 1000000).alias("entry"), "row", F.when(F.col("row") % 2 == 0, F.col("severity")).alias("severity"))
    return memory.append(rows.select(*columns), new, NOW)


@query(f"""with {ROWS_SQL} select vec_id, case when vec_id % 4 = 0 then 2 else severity end as severity, {NOW}::bigint as registered_at,
case when vec_id % 3 = 0 then {NOW} else last_hit end as last_hit, hit_count, 0::int as memory from bank""")
def o117_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    some = bank_rows(spark, sf_dir).select("vec_id", F.when(v % 4 != 0, F.col("severity")).alias("severity"), F.when(v % 3 != 0, F.col("last_hit")).alias("last_hit"), "hit_count")
    return memory.with_defaults(some, NOW).select("vec_id", "severity", "registered_at", "last_hit", "hit_count", "memory")


@query(f"""with {ROWS_SQL}, both_ as (select vec as a, list_transform(vec, lambda x: x * (1 + (vec_id % 5)::double / 1000)) as b from bank),
g as (select list_distance(a, b) / greatest(sqrt(list_dot_product(a, a)), 1e-12) as rel, list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) as gap from both_)
select round(max(rel), 6) as rel_max, round(avg(rel), 6) as rel_mean, round(max(gap), 6) as abs_max, max(rel) <= 0.005 as passed from g""")
def o86_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec")
    off = 1 + (F.col("id") % 5).cast("double") / 1000
    found = p.parity(rows, rows.withColumn("vec", F.transform("vec", lambda x: x * off)))
    return found.select(*[F.round(x, 6).alias(x) for x in ("rel_max", "rel_mean", "abs_max")], "passed")


@query(f"""with {ROWS_SQL}, images as (select tier, label, entry, count(*) as rows from bank group by all),
lines as (
  select 'i:' || entry || ':' || rows as line from images union all
  select 'a:' || entry || ':' || tier || ':' || case when label = '' then '_default' else label end || ':' || (1 + entry % 3) || ':0,' || entry % 5 || ',99' from images where entry % 7 <> 0)
select {digest_sql('line', 32)} as fingerprint from lines""")
def o88_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, given, _ = stored(spark, sf_dir)
    return a.fingerprint(images, given)


@query()
def o95_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir).select("vec_id", "entry", "row", "severity")
    return p.seeded_sample(rows, 200, ("vec_id",), rows.where("severity = 3 and row = 0"))


@query()
def o116_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built by k-means over every normal row, and the share of all rows that get the full scan's score with the probes measured for it."""
    rows = bank_rows(spark, sf_dir)
    normal, asked = rows.where("tier = 'normal'").select("entry", "row", "vec"), rows.select(F.col("vec_id").alias("id"), "entry", "vec")
    root = scratch_path(spark, "index")
    lists.built(normal, root)
    index = lists.opened(spark, root)
    n = lists.probes_for(asked, index, K, leave_out="entry")
    exact = nearest_mean(asked, index.rows(), K, "entry", ["id"]).withColumnRenamed("score", "exact")
    return lists.recall(lists.searched_mean(asked, index, K, n, "entry"), exact).withColumns({"probed": F.lit(n), "clusters": F.lit(index.centroids.count())})


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, row, vec: rows that cluster. Each vector gives ten, about centers that are the 256 vectors with the smallest ids, 4 a unit away, with its own parts, dealt anew, as unit noise."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    modes = rows.orderBy("vec_id").limit(256).select(F.monotonically_increasing_id().alias("i"), "v")
    modes = materialise(modes.withColumn("mode", F.row_number().over(Window.orderBy("i")) - 1).select("mode", F.col("v").alias("center")), "modes")  # 256 rows
    size = F.size("v")
    unit = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) / size)
    many = rows.withColumn("unit", unit).select("vec_id", "v", "unit", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("row"))  # once a vector, not once a part
    placed = many.withColumn("mode", F.pmod(F.xxhash64("vec_id", "row"), F.lit(modes.count())).cast("int")).join(F.broadcast(modes), "mode")
    turned = F.concat(F.slice("v", F.col("row") * 6 % size + 1, size), F.slice("v", F.lit(1), F.col("row") * 6 % size))
    vec = F.zip_with("center", turned, lambda c, x: c * 4 * F.sqrt(size.cast("double")) + x / F.greatest("unit", F.lit(1e-9)))
    return placed.select(F.col("vec_id").alias("entry"), "row", vec.alias("vec"))


@query("select count(*) * 10 as queries, true as found, true as few, 'kept' as again, 'extended' as later from embeddings")
def o116_mixture_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On rows that cluster: whether the default probes, under a quarter of the clusters, find at least 0.9 of the scores; and what the kept index does with the same bank and with one that has grown."""
    rows = materialise(mixture(spark, sf_dir), "mixture")
    root = scratch_path(spark, "index")
    lists.refreshed(rows.where("entry % 10 <> 0"), root)
    later = lists.refreshed(rows, root)
    again = lists.refreshed(rows, root)
    index = lists.opened(spark, root)
    asked = rows.select((F.col("entry") * 10 + F.col("row")).alias("id"), "entry", "vec")
    exact = lists.exact_mean(asked, rows, K, "entry").withColumnRenamed("score", "exact")
    clusters = index.centroids.count()
    found = lists.recall(lists.searched_mean(asked, index, K, c.NPROBE, "entry"), exact)
    return found.select("queries", (F.col("recall") >= 0.9).alias("found"), F.lit(4 * c.NPROBE < clusters).alias("few"), F.lit(again).alias("again"), F.lit(later).alias("later"))


@query()
def o121_normal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row on the two main axes of the normal rows."""
    return p.projected(bank_rows(spark, sf_dir).select("vec_id", "tier", "vec"), "normal")


@query()
def o123_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row on the axes that set anomalies apart (O-122), as there are anomalies."""
    return p.projected(bank_rows(spark, sf_dir).select("vec_id", "tier", "vec"))
