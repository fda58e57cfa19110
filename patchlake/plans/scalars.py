"""Queries of the column functions: names, groups, geometry, weights, quantised vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions import geometry as g
from patchlake.functions import identity as n
from patchlake.functions import scoring as s
from patchlake.operators.clusters import dimension_scales, scale_vector
from patchlake.plans.binding import FILE_NAME_SQL as NAME_SQL
from patchlake.plans.binding import NOW, ROWS_SQL, bank_rows, file_name
from patchlake.plans.registry import query
from patchlake.sources.shared import table

RAW_SQL = "case p_partkey % 6 when 0 then p_name when 1 then lower(p_brand) when 2 then '  ' || p_type || ' ' when 3 then '_default' when 4 then '###' else 'ab-' || p_size end"


def raw_label():
    k = F.col("p_partkey") % 6
    return F.when(k == 0, F.col("p_name")).when(k == 1, F.lower("p_brand")).when(k == 2, F.concat(F.lit("  "), "p_type", F.lit(" "))).when(k == 3, "_default").when(k == 4, "###").otherwise(F.concat(F.lit("ab-"), F.col("p_size").cast("string")))


@query(f"""
with r as (select p_partkey, trim({RAW_SQL}) as raw from part), j as (select *, regexp_replace(raw, '[^A-Za-z0-9_-]+', '_', 'g') as joined from r),
s as (select *, lower(trim(joined, '_')) as stem from j)
select p_partkey, case when raw = '' then '_default' when joined = raw and raw = lower(raw) then raw else case when stem = '' then 'c' else stem end || '-' || left(sha256(raw), 8) end as name from s""")
def o17_safe_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", n.safe_label(raw_label()).alias("name"))


@query(f"""
with s as (select p_partkey, left(trim(regexp_replace(lower(trim({RAW_SQL})), '[^a-z0-9-]+', '-', 'g'), '-'), 64) as x from part),
t as (select p_partkey, case when x = '' then 'standard' else x end as slug from s)
select p_partkey, slug || case when r = 1 then '' else '-' || r end as slug from (select *, row_number() over (partition by slug order by p_partkey) as r from t)""")
def o18_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs with -2, -3, ... for those that come again: counts by run of keys first, so a slug that all share stays in small windows."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "part").select("p_partkey", n.slug(raw_label()).alias("slug"), F.floor(F.col("p_partkey") / 256).alias("run"))
    counts = t.groupBy("slug", "run").agg(F.count("*").alias("c"))
    ahead = counts.select("slug", "run", F.coalesce(F.sum("c").over(Window.partitionBy("slug").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    put = t.withColumn("inside", F.row_number().over(Window.partitionBy("slug", "run").orderBy("p_partkey"))).join(ahead, ["slug", "run"])
    r = F.col("ahead") + F.col("inside")
    return put.select("p_partkey", F.concat("slug", F.when(r == 1, "").otherwise(F.concat(F.lit("-"), r.cast("string")))).alias("slug"))


@query(f"""
with f as (select event_id, {NAME_SQL} as name from events)
select event_id, left(regexp_replace(regexp_replace(name, '^.*[/\\\\]', ''), '[^A-Za-z0-9._-]', '_', 'g'), 128) as safe, lower(regexp_extract(name, '\\.([^.]*)$', 1)) in ('png','jpg','jpeg','bmp','tif','tiff','webp') as image from f""")
def o19_o20_image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", file_name().alias("name"))
    return t.select("event_id", n.safe_image_name(F.col("name")).alias("safe"), n.has_image_extension(F.col("name")).alias("image"))


def date_sql(shape: str, century: bool) -> str:
    shape = shape.replace("(?<!\\d)", "(?:^|[^0-9])").replace("(?!\\d)", "(?:[^0-9]|$)")
    texts = [f"regexp_extract_all(name, '{shape}', {i})" for i in (1, 2, 3)]
    ok = "z[2]::int between 1 and 12 and z[3]::int between 1 and 31" + (" and z[1]::int between 1900 and 2099" if century else "")
    zipped = f"list_transform(range(1, len({texts[0]}) + 1), lambda i: [{texts[0]}[i], {texts[1]}[i], {texts[2]}[i]])"
    return f"list_filter({zipped}, lambda z: {ok})[1]"


@query(f"""
with f as (select event_id, {NAME_SQL} as name from events)
select event_id, coalesce({", ".join(f"array_to_string({date_sql(*x)}, '')" for x in n.DATE_SHAPES)}, '') as grp from f""")
def o21_date_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", n.group_key(file_name(), "datetime").alias("grp"))


@query(f"""
with f as (select event_id, regexp_replace(regexp_replace({NAME_SQL}, '^.*[/\\\\]', ''), '\\.[^.]*$', '') as stem from events)
select event_id, array_to_string(list_slice(string_split(stem, '_'), 1, 2), '_') as grp from f""")
def o22_prefix_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", n.group_key(file_name(), "prefix", "_", 2).alias("grp"))


@query("select c_custkey, trim(coalesce(n_name, '')) as grp from customer left join (select * from nation where n_nationkey % 2 = 0) on c_nationkey = n_nationkey")
def o23_manual_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    both = table(spark, sf_dir, "customer").join(given, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return both.select("c_custkey", n.group_key(F.col("c_custkey"), "manual", manual=F.col("n_name")).alias("grp"))


@query(f"""
with f as (select regexp_extract({NAME_SQL}, '^[A-Za-z]+') as grp, {NAME_SQL} as name from events)
select grp, count(*) as images, min(name) as first_name, max(name) as last_name from f group by 1""")
def o24_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.regexp_extract(file_name(), "^[A-Za-z]+", 0).alias("grp"), file_name().alias("name"))
    return t.groupBy("grp").agg(F.count("*").alias("images"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query(f"with {ROWS_SQL} select vec_id, round((vec[1] / 255 - 0.485) / 0.229, 9) as r, round((vec[2] / 255 - 0.456) / 0.224, 9) as g, round((vec[3] / 255 - 0.406) / 0.225, 9) as b from bank")
def o25_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    means, devs = F.array(F.lit(0.485), F.lit(0.456), F.lit(0.406)), F.array(F.lit(0.229), F.lit(0.224), F.lit(0.225))
    t = bank_rows(spark, sf_dir).select("vec_id", F.transform(F.slice("vec", 1, 3), lambda v, i: (v / 255 - F.get(means, i)) / F.get(devs, i)).alias("x"))
    return t.select("vec_id", *[F.round(F.get("x", i), 9).alias(c) for i, c in enumerate("rgb")])


@query("""with i as (select o_orderkey, h, i, case when i < h then i else 2 * (h - 1) - i end as source from (select o_orderkey, 300 + o_orderkey % 1200 as h, unnest(range(0, greatest(518, 300 + o_orderkey % 1200))) as i from orders))
select o_orderkey, count(*) as places, min(source)::bigint as low, max(source)::bigint as high, sum(source * (i % 101))::bigint as mixed from i group by 1""")
def o26_reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a side that is mirrored up to a window, summed up by image."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", (300 + F.col("o_orderkey") % 1200).alias("h"))
    put = t.select("o_orderkey", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(518), F.col("h")) - 1)).alias("i"))
    source = g.reflected(F.col("i"), F.col("h")).cast("bigint")
    put = put.select("o_orderkey", "i", source.alias("source"))
    return put.groupBy("o_orderkey").agg(F.count("*").alias("places"), F.min("source").alias("low"), F.max("source").alias("high"), F.sum(F.col("source") * (F.col("i") % 101)).alias("mixed"))


def sides() -> tuple:
    return 300 + F.col("o_orderkey") % 1200, 400 + F.col("o_custkey") % 1500


AXIS = lambda x: f"list_distinct(list_append(range(0, {x} - 518 + 1, 388), {x} - 518))"


@query(f"""
with i as (select o_orderkey, 300 + o_orderkey % 1200 as h, 400 + o_custkey % 1500 as w from orders),
o as (select o_orderkey, case when h < 518 or w < 518 then [0::bigint] else {AXIS('h')} end as ys, case when h < 518 or w < 518 then [0::bigint] else {AXIS('w')} end as xs from i),
y as (select o_orderkey, unnest(ys) as y, xs from o), a as (select o_orderkey, y, unnest(xs) as x from y)
select o_orderkey, row_number() over (partition by o_orderkey order by y, x) - 1 as win, y::int as y, x::int as x from a""")
def o27_window_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(g.window_offsets(*sides())).alias("win", "at"))
    return t.select("o_orderkey", F.col("win").cast("bigint").alias("win"), "at.y", "at.x")


@query(f"select o_orderkey, (len({AXIS('greatest(518, 300 + o_orderkey % 1200)')}) * len({AXIS('greatest(518, 400 + o_custkey % 1500)')}) * 37 * 37)::bigint as rows from orders")
def o28_expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", g.expected_rows(*sides()).cast("bigint").alias("rows"))


@query(f"""
with i as (select o_orderkey, 300 + o_orderkey % 1200 as h, 400 + o_custkey % 1500 as w from orders),
r as (select o_orderkey, h, w, unnest([[0.1, 0.2, (o_orderkey % 7) / 20.0, 0.1], [0.5, 0.4, 0.05, (o_custkey % 5) / 25.0]]) as r from (select *, (select max(o_custkey) from orders o where o.o_orderkey = i.o_orderkey) as o_custkey from i)),
p as (select o_orderkey, h, w, r[1] * w as x0, r[2] * h as y0, (r[1] + r[3]) * w as x1, (r[2] + r[4]) * h as y1 from r where r[3] > 0 and r[4] > 0),
y as (select o_orderkey, unnest({AXIS('greatest(518, h)')}) as wy, {AXIS('greatest(518, w)')} as xs from i), a as (select o_orderkey, wy, unnest(xs) as wx from y),
n as (select *, row_number() over (partition by o_orderkey order by wy, wx) - 1 as win from a),
c as (select p.o_orderkey, win, greatest(0, floor((y0 - wy) / 14))::int as a, least(36, ceil((y1 - wy) / 14) - 1)::int as b, greatest(0, floor((x0 - wx) / 14))::int as c, least(36, ceil((x1 - wx) / 14) - 1)::int as d from p join n on p.o_orderkey = n.o_orderkey),
e as (select o_orderkey, win, c, d, unnest(range(a, b + 1)) as py from c where a <= b and c <= d), f as (select o_orderkey, win, py, unnest(range(c, d + 1)) as px from e)
select o_orderkey, count(*) as n_rows, min(g) as first_row, max(g) as last_row, sum(g)::bigint as sum_rows from (select distinct o_orderkey, win * 1369 + py * 37 + px as g from f) group by 1""")
def o29_rows_for_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), w.alias("w"), h.alias("h"))
    rects = F.array(rect(0.1, 0.2, (F.col("o_orderkey") % 7) / 20.0, F.lit(0.1)), rect(0.5, 0.4, F.lit(0.05), (F.col("o_custkey") % 5) / 25.0))
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(g.rows_for_rects(*sides(), rects)).alias("g")).withColumn("g", F.col("g").cast("bigint"))
    return t.groupBy("o_orderkey").agg(F.count("*").alias("n_rows"), F.min("g").alias("first_row"), F.max("g").alias("last_row"), F.sum("g").alias("sum_rows"))


@query(f"""
with {ROWS_SQL}, w as (select vec_id, severity / 2.0 as weight, exp(-greatest({NOW} - last_hit, 0) / [100.0, 1000.0, 10000.0][memory + 1]) as fresh from bank)
select vec_id, round(weight, 9) as weight, round(fresh, 9) as fresh, round(weight * fresh, 9) as multiplier, greatest(1, least(3, vec_id % 6)) as clamped from w""")
def o30_o33_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, now = bank_rows(spark, sf_dir), F.lit(NOW)
    parts = (F.col("last_hit"), F.col("memory"))
    return t.select("vec_id", F.round(s.severity_weight(F.col("severity")), 9).alias("weight"), F.round(s.freshness(now, *parts), 9).alias("fresh"), F.round(s.multiplier(F.col("severity"), now, *parts), 9).alias("multiplier"), s.clamped_severity(F.col("vec_id") % 6).alias("clamped"))


@query("select event_id, round(value + case when event_id % 3 > 0 then 20.0 / (1 + event_id % 7) else 0 end - case when event_id % 2 > 0 then 5.0 / (1 + user_id % 11) else 0 end, 9) as composed from events")
def o34_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    crit, neg = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 7), F.when(F.col("event_id") % 2 > 0, F.col("user_id") % 11)
    return table(spark, sf_dir, "events").select("event_id", F.round(s.composed(F.col("value"), crit, neg, 20.0, 5.0), 9).alias("composed"))


@query("""select event_id, case event_type when 'error' then case when value > 20 then 'ng' else 'miss' end when 'click' then 'neg' else case when value > 20 then 'fp' else 'ok' end end as kind,
  case when user_id % 4 > 0 then round(greatest(0, least(1, (value - 5) / (2.0 * (user_id % 4) * 10))) * 100, 9) end as degree from events""")
def o36_o37_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "negative").otherwise("normal")
    high = 5 + F.col("user_id") % 4 * 10
    return table(spark, sf_dir, "events").select("event_id", s.verdict(tier, F.col("value"), F.lit(20.0)).alias("kind"), F.round(s.ng_degree(F.col("value"), F.lit(5.0), high), 9).alias("degree"))


@query(f"""
with {ROWS_SQL}, x as (select vec_id, unnest(range(64)) as i, vec from bank), m as (select i, max(abs(vec[i + 1])) / 127 as s from x group by 1),
c as (select vec_id, x.i, greatest(-127, least(127, round_even(vec[x.i + 1] / case when s > 0 then s else 1 end, 0)))::bigint as code, case when s > 0 then s else 1 end as s, vec[x.i + 1] as v from x join m on x.i = m.i)
select vec_id, sum(code)::bigint as codes, sum(code * (i + 1))::bigint as weighted, round(max(abs(code * s - v) / s), 6) <= 0.5 as close from c group by 1""")
def o40_o41_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    scale = scale_vector(dimension_scales(rows))
    q = rows.crossJoin(F.broadcast(scale)).withColumn("codes", s.quantised(F.col("vec"), F.col("scale")))  # one row
    back = F.array_max(F.zip_with(F.zip_with(s.dequantised(F.col("codes"), F.col("scale")), "vec", lambda a, b: F.abs(a - b)), "scale", lambda d, x: d / x))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, c: a + c)
    return q.select("vec_id", total("codes").alias("codes"), total(F.transform("codes", lambda c, i: c.cast("bigint") * (i + 1))).alias("weighted"), (F.round(back, 6) <= 0.5).alias("close"))


@query("select event_id, (ceil(greatest(64, floor(value * 10 + 0.5)) / 14) * 14)::int as side from events")
def o163_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", g.snapped(F.col("value") * 10, 14).alias("side"))


@query(f"with {ROWS_SQL} select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: case when (i - 1) in (0, 3, 8, 21) then vec[i] else -1e9 end)), 3) as total from bank")
def o39_masked_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = s.masked_logits(F.col("vec"), F.array(F.lit(3), F.lit(8), F.lit(21)))
    return bank_rows(spark, sf_dir).select("vec_id", F.round(F.aggregate(masked, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))
