"""Queries of what is kept on disk and brought up to date: folders, split banks, stores, evaluations, capped images, whole flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions import colors
from patchlake.functions.digest import digest_sql
from patchlake.operators import assembly as a
from patchlake.operators import evaluations as ev
from patchlake.operators import memory as m
from patchlake.operators import projection as p
from patchlake.operators.scorer import scored_images
from patchlake.plans.binding import CEILING, LABELS_SQL, NOW, ROWS_SQL, bank_rows, stored, topk_sql
from patchlake.plans.registry import query
from patchlake.sources.bank_format import read_folder, write_folder, write_metadata
from patchlake.sources.shared import materialise, scratch_path, table
from patchlake.sources.split_bank import SplitBank
from patchlake.sources.versions import FeatureStore

META = ("severity", "last_hit", "hit_count", "memory")
FRESH_SQL = f"exp(-greatest({NOW} - last_hit, 0) / [100.0, 1000.0, 10000.0][memory + 1])"


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank with metadata of the kinds that are stored."""
    rows = bank_rows(spark, sf_dir)
    return rows.select("tier", "label", "entry", "row", "vec", F.col("severity").cast("int").alias("severity"), F.lit(0).cast("bigint").alias("registered_at"), "last_hit", "hit_count", F.col("memory").cast("int").alias("memory"))


@query(f"""with {ROWS_SQL} select tier, label, entry, row as place, case when tier = 'normal' then 0 when tier = 'negative' then 1 else severity end::int as severity, case when tier <> 'normal' then hit_count + case when tier = 'critical' then 5 else 0 end else -1 end as hit_count
from bank where not (tier = 'negative' and entry % 2 = 1)""")
def o1_o2_o3_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank saved as a folder; then one tier saved anew, with fewer images, and one tier's metadata alone; all read back."""
    path = scratch_path(spark, "folder")
    bank = whole(spark, sf_dir).withColumns({"place": F.col("row"), "name": F.concat(F.lit("image"), "entry")})
    write_folder(bank, path, inspection_count=NOW)
    write_folder(bank.where("tier = 'negative' and entry % 2 = 0").withColumn("severity", F.lit(1)), path, ("negative",))
    write_metadata(bank.where("tier = 'critical'").withColumn("hit_count", F.col("hit_count") + 5).drop("vec"), path, "critical")
    return read_folder(spark, path).select("tier", "label", F.col("entry").cast("bigint").alias("entry"), "place", F.coalesce("severity", F.lit(0)).alias("severity"), F.coalesce("hit_count", F.lit(-1)).alias("hit_count"))


@query(f"""with {ROWS_SQL}, hit as (select *, case when tier <> 'normal' and row < 3 then {NOW} else last_hit end as hit_at, hit_count + case when tier <> 'normal' and row < 3 then 1 else 0 end as hits from bank),
marked as (select * replace (hit_at as last_hit, hits as hit_count) from hit)
select vec_id, last_hit, hit_count, case when tier <> 'normal' and memory = 0 and hit_count >= 3 then 1 when tier <> 'normal' and memory = 1 and hit_count >= 10 then 2 else memory end::int as memory
from marked where not (tier <> 'normal' and memory = 0 and {FRESH_SQL} < 0.05)""")
def o3_o106_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and decay on metadata kept apart from vectors."""
    bank = whole(spark, sf_dir)
    split = SplitBank.create(bank, scratch_path(spark, "split"), buckets=4)
    hits = bank.where("tier <> 'normal' and row < 3").select(*m.KEY)
    split.change(lambda meta: m.hit(meta, hits, NOW))
    split.change(lambda meta: m.decay(meta, NOW))
    return split.rows().select((F.col("entry") * 10 + F.col("row")).alias("vec_id"), "last_hit", "hit_count", "memory")


@query(f"""with {ROWS_SQL}, images as (select entry, count(*) as rows from bank group by 1),
first as (select entry, rows, row_number() over (order by entry) as n from images where entry % 3 <> 0),
later as (select entry, rows, (select count(*) from first) + row_number() over (order by entry) as n from images where entry % 3 = 0)
select printf('%06d', n) as id, 'image' || entry as name, rows from (select * from first where n % 4 <> 1 union all select * from later)""")
def o5_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of images with ids that never come back; every fourth of the first is removed between them, and what is left is written anew."""
    rows = bank_rows(spark, sf_dir).select(F.col("entry").alias("image"), F.concat(F.lit("image"), "entry").alias("name"), "row", "vec")
    store = FeatureStore(spark, scratch_path(spark, "store"))
    given = store.add(rows.where("image % 3 <> 0"))
    store.remove(given.where("cast(id as int) % 4 = 1"))
    store.add(rows.where("image % 3 = 0"))
    store.compact()
    counted = store.features().groupBy("id").agg(F.count("*").alias("rows"))
    return store.entries().select("id", "name").join(counted, "id")


LATER_SQL = """later as (select * replace (case when tier <> 'normal' and entry % 11 = 0 then list_transform(vec, lambda x: x * 2) else vec end as vec) from bank where tier = 'normal' or entry % 7 <> 0)"""
EVALUATED_SQL = f"""with {ROWS_SQL}, {LATER_SQL}, {topk_sql("q.entry <> b.entry").replace("from bank where", "from later where")}
select entry, tier, round(max(score), 6) as score_max, round(avg(score), 6) as score_mean, case when tier <> 'normal' and (entry % 3 = 0 or entry % 11 = 0) then 2 else 1 end::bigint as since from scored group by entry, tier"""


def evaluated_twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A bank and its evaluations, made for part of the images first, and brought up to date after images came, went and changed."""
    bank, root = bank_rows(spark, sf_dir).select("tier", "label", "entry", "row", "vec"), scratch_path(spark, "evaluations")
    ev.brought_up(bank.where("tier = 'normal' or entry % 3 <> 0"), root)
    twice = F.when((F.col("tier") != "normal") & (F.col("entry") % 11 == 0), F.transform("vec", lambda x: x * 2)).otherwise(F.col("vec"))
    later = bank.where("tier = 'normal' or entry % 7 <> 0").withColumn("vec", twice)
    ev.brought_up(later, root)
    return later, ev.kept(spark, root)


@query(EVALUATED_SQL)
def o53_brought_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluated_twice(spark, sf_dir)[1]
    return found.select("entry", "tier", F.round("score_max", 6).alias("score_max"), F.round("score_mean", 6).alias("score_mean"), "since")


@query(f"""with {ROWS_SQL}, {LATER_SQL}, left_over as (select * from later where not (tier <> 'normal' and entry % 4 = 0))
select tier, count(*) as rows, count(distinct entry) as images, count(distinct entry) as evaluations from left_over group by 1""")
def o127_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of labelled tiers deleted with their evaluations; the others' stay."""
    bank, found = evaluated_twice(spark, sf_dir)
    rows, left = ev.without_images(bank, found, bank.where("tier <> 'normal' and entry % 4 = 0").select("entry"))
    sizes = rows.groupBy("tier").agg(F.count("*").alias("rows"), F.count_distinct("entry").alias("images"))
    return sizes.join(left.groupBy("tier").agg(F.count("*").alias("evaluations")), "tier")


@query(f"""with {ROWS_SQL} select tier, label, entry, (case when tier = 'normal' then 10 else least(10, greatest(6, count(*) filter (severity <> 2))) end)::bigint as rows,
case when tier <> 'normal' then count(*) filter (severity <> 2) else 0 end as marked from bank group by tier, label, entry having count(*) = 10""")
def o115_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most six rows of each labelled image, all of its marked rows among them and first."""
    bank = whole(spark, sf_dir)
    out = materialise(a.reduced_bank(bank, m.row_starts(bank.where("tier <> 'normal'")), 6), "reduced")
    marked = F.count_if((F.col("tier") != "normal") & (F.col("severity") != 2))
    full = bank.groupBy("entry").count().where("count = 10").select("entry")
    return out.join(full, "entry", "left_semi").groupBy("tier", "label", "entry").agg(F.count("*").alias("rows"), marked.alias("marked"))


@query(f"""with {ROWS_SQL}, images as (select tier, label, entry, count(*) as n from bank where entry % 7 <> 0 group by all),
ranked as (select *, row_number() over (partition by tier order by n, entry) - 1 as i, count(*) over (partition by tier) as k, sum(n) over (partition by tier) as total from images where n = 10),
held as (select tier, label, entry, case when total <= {CEILING} then n else least(n, greatest(1, {CEILING} // k + (i >= k - ({CEILING} - k * ({CEILING} // k)))::int)) end as rows,
  case when entry % 2 = 0 then 7 else 0 end as hits, case when entry % 2 = 0 then {NOW} - 500 else {NOW} end as last_hit from ranked),
came as (select 'critical' as tier, 'new' as label, entry, 4 as rows, 0 as hits, {NOW} as last_hit from bank where entry % 7 = 0 group by entry having count(*) = 10),
hit as (select tier, label, entry, rows, hits + (tier <> 'normal' and entry % 3 = 0)::int as hits, case when tier <> 'normal' and entry % 3 = 0 then {NOW} + 10 else last_hit end as last_hit from (select * from held union all select * from came))
select tier, label, entry, rows::bigint as rows, hits::bigint as hits, last_hit::bigint as last_hit, (tier <> 'normal' and hits >= 3)::int as memory from hit
where not (tier <> 'normal' and exp(-({NOW} + 10 - last_hit) / 100.0) < 0.05) and entry % 11 <> 0""")
def o110_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembly with a ceiling and an earlier bank, then images with a cap of four rows appended, hits, decay and a deletion, in a row."""
    images, given, features = stored(spark, sf_dir)
    full = materialise(images.where("rows = 10").select("entry"), "full")  # images of a whole grid
    images, given, features = (t.join(full, "entry", "left_semi") for t in (images, given, features))
    first = materialise(a.assemble(images, given, features, CEILING, NOW), "first")
    earlier = first.where("entry % 2 = 0").withColumns({"hit_count": F.lit(7).cast("bigint"), "last_hit": F.lit(NOW - 500).cast("bigint")})
    bank = materialise(a.assemble(images, given, features, CEILING, NOW, earlier), "bank")
    new = features.where("entry % 7 = 0").select(F.lit("critical").alias("tier"), F.lit("new").alias("label"), "entry", F.concat(F.lit("image"), "entry").alias("name"), "row", "vec")
    bank = materialise(a.appended(bank, new, NOW, 4, start_from_held=True), "appended")
    bank = m.hit(bank, bank.where("tier <> 'normal' and entry % 3 = 0"), NOW + 10)
    bank = m.remove(m.decay(bank, NOW + 10), bank.where("entry % 11 = 0").select("entry").distinct())
    return bank.groupBy("tier", "label", "entry").agg(F.count("*").alias("rows"), F.max("hit_count").alias("hits"), F.max("last_hit").alias("last_hit"), F.max("memory").alias("memory"))


DIGEST_SQL = f"""with {ROWS_SQL}, images as (
  select tier, label, entry, count(*) as n, case when tier = 'normal' then '' else coalesce(string_agg(row::varchar, ',' order by row) filter (severity = 3), '') end as marks from bank group by tier, label, entry),
lines as (select tier, concat_ws(':', tier, label, entry::varchar, n::varchar, marks) as line from images)"""


def named_digest_sql(line: str) -> str:
    """The SQL of a digest with (empty) settings before its sums."""
    return digest_sql(line).replace("concat_ws(',', ", "concat_ws(',', '', ", 1)


@query(f"{DIGEST_SQL} select {named_digest_sql("case when tier = 'normal' then line end")} as evaluation, {named_digest_sql('line')} as content from lines")
def o88_bank_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.bank_digests(whole(spark, sf_dir))


@query(f"""with {ROWS_SQL}, t as (select tier, count(*) as total from bank group by 1)
select tier, total, least(total, 800) as sampled, case when (select count(*) from bank where tier <> 'normal') >= 2 then 'anomaly' else 'normal' end as mode from t""")
def o123_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each tier the map shows, with scores and axes that leave an image's own rows out."""
    bank = bank_rows(spark, sf_dir).select("tier", "label", "entry", "row", "vec")
    points, info = p.projection(bank, with_scores=True, leave_own=True)
    shown = points.where("x is not null and score is not null").groupBy("tier").agg(F.count("*").alias("sampled"))
    totals = bank.groupBy("tier").agg(F.count("*").alias("total"))
    return totals.join(shown, "tier").withColumn("mode", F.lit(info["mode"]))


@query(f"""with {ROWS_SQL}, x as (select vec_id, unnest(range(1, len(vec) + 1)) as i, unnest(vec) as v from bank where tier = 'normal'),
d as (select i, count(*) as n, var_pop(v) as variance, avg(v) as mean from x group by i)
select max(n) as n, round(sum(variance), 6) as variance, round(sum(mean * mean), 6) as mean_square from d""")
def o121_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, total variance and squared mean of the normal rows, from the sums that the axes are made of."""
    n, total, outer = p.moments(bank_rows(spark, sf_dir).where("tier = 'normal'"))
    mean = total / n
    return spark.createDataFrame([(n, float(outer.trace() / n - mean @ mean), float(mean @ mean))], "n bigint, variance double, mean_square double").select("n", F.round("variance", 6).alias("variance"), F.round("mean_square", 6).alias("mean_square"))


HEAT_SQL = """pixels as (select l_orderkey as image, l_linenumber as k, l_extendedprice::double as heat, (l_partkey % 256)::double as r, (l_suppkey % 256)::double as g, (l_orderkey % 256)::double as b from lineitem),
limits as (select image, quantile_cont(heat, 0.05) as vmin, case when quantile_cont(heat, 0.99) = 0 then 1.0 else quantile_cont(heat, 0.99) end as vmax from pixels group by 1),
put as (select p.*, image % 3 = 0 as anchored, floor(least(greatest((heat - vmin) / greatest(vmax - vmin, 1e-6), 0.0), 1.0) * 255) / 255 as x, least(greatest((heat - 40000.0) / 30000.0, -1.0), 1.0) as t from pixels p join limits using (image))"""


def channel_sql(name: str, middle: int, limit: int, good: int, bad: int) -> str:
    own = f"floor(least(greatest(1.5 - abs(4 * x - {middle}), 0.0), 1.0) * 255 + 0.5)"
    fixed = f"({limit} * (1 - greatest(-t, 0.0) - greatest(t, 0.0)) + {good} * greatest(-t, 0.0) + {bad} * greatest(t, 0.0))"
    mixed = lambda c: f"least(greatest({name} * 0.55::double + {c} * 0.45::double, 0.0), 255.0)"
    return f"case when anchored then floor({mixed(fixed)}) else round_even({mixed(own)}, 0) end::bigint"


@query(f"with {HEAT_SQL} select image % 100 as block, count(*) as pixels, " + ", ".join(f"sum({channel_sql(n, 3 - i, colors.LIMIT[i], colors.GOOD[i], colors.BAD[i])})::bigint as {n}" for i, n in enumerate(colors.CHANNELS)) + " from put group by 1")
def o42_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat maps over images, a third of them on the scale about a threshold; channels added up by block of images."""
    channel = lambda c: (F.col(c) % 256).cast("double")
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("k"), F.col("l_extendedprice").cast("double").alias("heat"), channel("l_partkey").alias("r"), channel("l_suppkey").alias("g"), channel("l_orderkey").alias("b"))
    anchors = pixels.where("image % 3 = 0").select("image").distinct().withColumns({"low": F.lit(10000.0), "high": F.lit(40000.0)})
    out = colors.overlays(pixels, anchors)
    return out.groupBy((F.col("image") % 100).alias("block")).agg(F.count("*").alias("pixels"), *[F.sum(c).alias(c) for c in colors.CHANNELS])


@query(f"""with {ROWS_SQL}, {topk_sql("q.entry <> b.entry")}, {LABELS_SQL},
least as (select vec_id, min(distance) filter (tier = 'critical') as critical, min(distance) filter (tier = 'negative') as negative from best group by 1),
composed as (select s.vec_id, s.entry, s.row, score + coalesce(20.0 / (1 + critical), 0) - coalesce(5.0 / (1 + negative), 0) as score from scored s left join least l on s.vec_id = l.vec_id),
tops as (select entry, avg(score) as topk from (select *, row_number() over (partition by entry order by score desc, row) as r from composed) where r <= 3 group by 1)
select entry, count(*) as patches, round(max(score), 5) as score_max, round(avg(score), 5) as score_mean, round(any_value(topk), 5) as topk from composed join tops using (entry) group by 1""")
def o149_scored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image scored at once, with weighted labels and without its own rows."""
    rows = bank_rows(spark, sf_dir)
    bank = rows.withColumn("id", F.col("vec_id"))
    images = scored_images(rows, bank, 5, 20.0, 5.0, "entry", True, NOW, 3)[1]
    return images.select("entry", "patches", *[F.round(c, 5).alias(c) for c in ("score_max", "score_mean", "topk")])


@query(f"""with {ROWS_SQL}, moved as (select vec_id, list_transform(vec, lambda x: x * (1 + (vec_id % 5)::double / 100000)) as vec from bank),
near as (
  select kind, q.vec_id, list_distance(q.vec, b.vec) as d, row_number() over (partition by kind, q.vec_id order by list_distance(q.vec, b.vec)) as r
  from (select 'a' as kind, vec_id, vec from bank where tier <> 'normal' union all select 'b', vec_id, vec from moved where vec_id in (select vec_id from bank where tier <> 'normal')) q, (select vec from bank where tier = 'normal') b),
s as (select vec_id, avg(d) filter (kind = 'a') as a, avg(d) filter (kind = 'b') as b from near where r <= 10 group by 1)
select round(avg(abs(b - a) / greatest(a, 1e-9) * 100), 6) as drift_mean, round(max(abs(b - a) / greatest(a, 1e-9) * 100), 6) as drift_max, avg(abs(b - a) / greatest(a, 1e-9) * 100) <= 0.05 as passed from s""")
def o86_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far scores against the normal rows move when the labelled rows' vectors do, a little."""
    rows = bank_rows(spark, sf_dir)
    odd = rows.where("tier <> 'normal'").select(F.col("vec_id").alias("id"), "vec")
    off = 1 + (F.col("id") % 5).cast("double") / 100000
    found = p.scored_parity(odd, odd.withColumn("vec", F.transform("vec", lambda x: x * off)), rows.where("tier = 'normal'"))
    return found.select(F.round("drift_mean", 6).alias("drift_mean"), F.round("drift_max", 6).alias("drift_max"), "passed")
