"""Queries of masks; pixels come from `lineitem`.

The plain queries, with their SQL, fold all orders into 300 images, so their table
has one size however large the input is. Each has a twin named `..._by_order`, where
every order is an image and the number of images grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.scoring import thresholded_class
from patchlake.operators import masks as m
from patchlake.plans.registry import ORACLES, query
from patchlake.sources.shared import table

PIXELS_SQL = """pixels as (select l_orderkey % 300 as image, (l_orderkey // 300) % 12 as y, l_partkey % 15 as x, min(case l_returnflag when 'A' then 1 when 'N' then 2 when 'R' then 0 else 3 end + case when l_suppkey % 29 = 0 then 4 else 0 end) as class, max(l_discount * 10) as confidence from lineitem group by 1, 2, 3)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 0).otherwise(3) + F.when(F.col("l_suppkey") % 29 == 0, 4).otherwise(0)
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy((F.col("l_orderkey") % 300).alias("image"), (F.floor(F.col("l_orderkey") / 300) % 12).alias("y"), (F.col("l_partkey") % 15).alias("x")).agg(F.min(flag).alias("class"), F.max(F.col("l_discount") * 10).alias("confidence"))


@query(f"with {PIXELS_SQL} select image, y, x, case when class > 0 and confidence < 0.4 then 0 else class end as class from pixels")
def o35_thresholded(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    return pixels(spark, sf_dir).select("image", "y", "x", thresholded_class(F.col("class"), F.col("confidence"), 0.4).alias("class"))


@query(f"""with {PIXELS_SQL}, e as (select image, case when class = 5 then 'ignored' when class > 0 and pred = class then 'tp' when pred > 0 and pred <> class then 'fp' when class > 0 then 'fn' else 'tn' end as kind from (select *, (class + (x + y) % 3) % 4 as pred from pixels))
select kind, count(*) as pixels, count(distinct image) as images from e group by 1""")
def o42_error_map(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    t = pixels(spark, sf_dir).select("image", F.when(F.col("class") == 5, m.IGNORED).otherwise(F.col("class")).alias("gt"), ((F.col("class") + (F.col("x") + F.col("y")) % 3) % 4).alias("pred"))
    return m.error_map(t).groupBy("kind").agg(F.count("*").alias("pixels"), F.countDistinct("image").alias("images"))


@query(f"""with {PIXELS_SQL}, c as (select i::int as id from range(9) t(i)), s as (select class as id, count(distinct image) as images from pixels group by 1)
select c.id, coalesce(images, 0) as images, c.id = 0 or (c.id <> 1 and coalesce(images, 0) > 0) as active from c left join s on c.id = s.id""")
def o81_class_presence(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    classes = spark.range(9).select(F.col("id").cast("int").alias("id"), (F.col("id") != 1).alias("active"))
    return m.class_presence(pixels(spark, sf_dir), classes).select("id", "images", "active")


@query(f"with {PIXELS_SQL} select distinct class as id, 'recovered-' || class as name from pixels where class not in (0, 1, 2, 255)")
def o60_orphan_classes(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    return m.orphan_classes(pixels(spark, sf_dir), spark.range(3).select(F.col("id").cast("int").alias("id")))


@query(f"with {PIXELS_SQL} select image, max(class > 0) as has_foreground, coalesce(string_agg(distinct class::varchar, ',' order by class::varchar) filter (class > 0), '') as class_ids from pixels group by 1")
def o136_mask_summary(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    return m.mask_summary(pixels(spark, sf_dir)).select("image", "has_foreground", F.array_join(F.col("class_ids").cast("array<string>"), ",").alias("class_ids"))


@query(f"with {PIXELS_SQL} select case when class = 2 then 0 else class end as class, count(*) as pixels from pixels group by 1")
def o137_purge_class(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    return m.purge_class(pixels(spark, sf_dir), 2).groupBy("class").agg(F.count("*").alias("pixels"))


def labelled_sql(diagonal: bool) -> str:
    near = "greatest(abs(p.y - q.y), abs(p.x - q.x)) <= 1" if diagonal else "abs(p.y - q.y) + abs(p.x - q.x) <= 1"
    return f"""{PIXELS_SQL}, fg as (select *, y * 100 + x as id from pixels where class > 0),
reach as (select image, class, id, y, x, id as root from fg union select q.image, q.class, q.id, q.y, q.x, p.root from reach p join fg q on p.image = q.image and p.class = q.class and {near}),
parts as (select image, class, id, y, x, min(root) as part from reach group by all),"""


@query(f"with recursive {labelled_sql(True)} r as (select p.image, p.class, part, count(*) as area, min(p.y) as y0, min(p.x) as x0, max(p.y) as y1, max(p.x) as x1, avg(confidence) as c from parts p join pixels q on p.image = q.image and p.y = q.y and p.x = q.x group by all) select image, class, area, y0::int as y0, x0::int as x0, y1::int as y1, x1::int as x1, round(c, 6) as confidence from r")
def o82_regions(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    return m.regions(pixels(spark, sf_dir)).select("image", "class", "area", "y0", "x0", "y1", "x1", F.round("confidence", 6).alias("confidence"))


@query(f"with recursive {labelled_sql(False)} s as (select image, class, part, count(*) as area from parts group by all), k as (select p.image, p.y, p.x from parts p join s using (image, class, part) where area between 2 and 6) select q.image, q.y, q.x, case when k.y is null then 0 else q.class end as class from pixels q left join k on q.image = k.image and q.y = k.y and q.x = k.x")
def o83_size_filter(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    return m.size_filter(pixels(spark, sf_dir), 2, 6).select("image", "y", "x", "class")


CLOSED_SQL = """offs as (select dy, dx from range(-1, 2) a(dy), range(-1, 2) b(dx)),
ext as (select image, max(y) as h, max(x) as w from pixels group by 1),
grown as (select distinct image, class, y + dy as y, x + dx as x, h, w from pixels join ext using (image), offs where class > 0 and y + dy between 0 and h and x + dx between 0 and w),
near as (select image, class, h, w, y - dy as cy, x - dx as cx from grown, offs),
closed as (
  select image, class, cy as y, cx as x from near where cy between 0 and h and cx between 0 and w group by image, class, cy, cx, h, w
  having count(*) = (least(cy + 1, h) - greatest(cy - 1, 0) + 1) * (least(cx + 1, w) - greatest(cx - 1, 0) + 1)),
won as (select image, y, x, max(class) as class from closed group by all)"""


@query(f"with {PIXELS_SQL}, {CLOSED_SQL} select p.image, p.y, p.x, coalesce(w.class, 0)::int as class from pixels p left join won w on p.image = w.image and p.y = w.y and p.x = w.x")
def o84_morphology(spark: SparkSession, sf_dir: str, pixels=pixels) -> DataFrame:
    return m.morphology(pixels(spark, sf_dir), "close", 3).select("image", "y", "x", "class")


ORDER_PIXELS_SQL = PIXELS_SQL.replace("l_orderkey % 300 as image, (l_orderkey // 300) % 12 as y", "l_orderkey as image, l_suppkey % 12 as y")


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 0).otherwise(3) + F.when(F.col("l_suppkey") % 29 == 0, 4).otherwise(0)
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_orderkey").alias("image"), (F.col("l_suppkey") % 12).alias("y"), (F.col("l_partkey") % 15).alias("x")).agg(F.min(flag).alias("class"), F.max(F.col("l_discount") * 10).alias("confidence"))


def by_order(f) -> None:
    """Register a query's twin; its SQL is the query's with the other pixels."""

    def twin(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, order_pixels)

    twin.__name__ = f"{f.__name__}_by_order"
    query(ORACLES[f.__name__].replace(PIXELS_SQL, ORDER_PIXELS_SQL) if f.__name__ in ORACLES else None)(twin)


for _f in (o35_thresholded, o42_error_map, o81_class_presence, o60_orphan_classes, o136_mask_summary, o137_purge_class, o82_regions, o83_size_filter, o84_morphology):
    by_order(_f)
