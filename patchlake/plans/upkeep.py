"""Queries of upkeep: new ids, places of rows, counters, ceilings, staged inputs, states, lookups; projects are nations, banks are customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.operators import upkeep as u
from patchlake.plans.binding import ROWS_SQL, bank_rows
from patchlake.plans.registry import query
from patchlake.sources.shared import table


@query("select p_partkey, printf('%06d', 999900 + row_number() over (order by p_partkey)) as entry_id from part")
def o5_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.with_new_ids(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 999900)


@query("select vec_id, vec_id // 10 as entry from embeddings where vec_id // 10 in (select s_suppkey from supplier)")
def o5_features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entry"))
    return u.features_of(bank_rows(spark, sf_dir).select("vec_id", "entry"), wanted)


@query(f"""with {ROWS_SQL}, placed as (select *, row_number() over (partition by tier, label order by entry, row) - 1 as position from bank)
select event_id, entry, row from events join placed on position = event_id and tier = 'normal'""")
def o52_images_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = table(spark, sf_dir, "events").select("event_id", F.lit("normal").alias("tier"), F.lit("").alias("label"), F.col("event_id").alias("position"))
    return u.images_at(positions, bank_rows(spark, sf_dir)).select("event_id", "entry", "row")


@query("select event_id, (row_number() over (order by user_id, event_id) - 1)::bigint as place from events")
def o92_cluster_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.cluster_places(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", F.col("place").cast("bigint").alias("place"))


@query(f"with {ROWS_SQL} select vec_id, tier, case when tier <> 'normal' then severity else 0 end::bigint as severity from bank")
def o99_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir).select("vec_id", "tier", "severity")
    parts = [rows.where(F.col("tier") == t) for t in ("normal", "critical", "negative")]
    out = u.combined(parts[1], parts[2], parts[0].drop("severity"))
    return out.withColumn("severity", F.coalesce("severity", F.lit(0)).cast("bigint"))


@query("select c_custkey as bank, 5 + count(o_orderkey) as counter from customer left join orders on c_custkey = o_custkey group by 1")
def o105_ticked(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bank"), F.lit(5).cast("bigint").alias("counter"))
    return u.ticked(counters, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bank")))


@query("select p_partkey, case when p_size <= 10 then 4096 else greatest(32, least(4096, floor(p_partkey * 1048576.0 * 0.6::double / ((p_size - 10) * 1000 * 2 * 3.0::double)))) end::bigint as chunk from part")
def o118_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", u.chunk_rows((F.col("p_size") - 10) * 1000, F.col("p_partkey") * 1048576.0).alias("chunk"))


@query("""with d as (select n_name as capacity, n_nationkey * 100 as ceiling, case n_nationkey % 5 when 0 then '-7' when 1 then 'many' when 2 then ' 12 ' when 3 then '1.5' end as value from nation),
c as (select capacity, case when value = '-7' then 0 when value = ' 12 ' then 12 else ceiling end::bigint as ceiling from d),
b as (select c_custkey, case when n_name is not null and c_custkey % 3 > 0 then n_name else 'FRANCE' end as capacity from customer left join nation on c_nationkey = n_nationkey)
select c_custkey, b.capacity, coalesce(ceiling, 0)::bigint as ceiling from b left join c using (capacity)""")
def o131_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 5
    value = F.when(k == 0, "-7").when(k == 1, "many").when(k == 2, " 12 ").when(k == 3, "1.5")
    limits = u.ceilings(nations.select(F.col("n_name").alias("capacity"), (F.col("n_nationkey") * 100).cast("bigint").alias("ceiling")), nations.select(F.col("n_name").alias("capacity"), value.alias("value")))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    banks = customers.select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("n_name")).otherwise("huge").alias("capacity"))
    return u.bank_ceiling(banks, limits, "FRANCE").select("c_custkey", "capacity", "ceiling")


@query("select o_orderkey as name, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as reached from orders")
def o132_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("taken"))
    reached, left = u.consumed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name")), taken)
    return reached.withColumn("reached", F.lit(True)).unionByName(left.withColumn("reached", F.lit(False)))


@query("select c_custkey as bank, s_suppkey is null or c_mktsegment <> 'BUILDING' or c_nationkey <> s_nationkey as stale from customer left join supplier on c_custkey = s_suppkey")
def o135_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    banks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bank"), F.col("c_mktsegment").alias("labelset"), F.col("c_nationkey").alias("fingerprint"))
    states = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bank"), F.lit("BUILDING").alias("labelset"), F.col("s_nationkey").alias("fingerprint"))
    return u.stale(banks, states).select("bank", "stale")


@query("select distinct case when l_linenumber < 4 then 'listed' else 'recovered-' || l_linenumber end as name, l_linenumber::int as id from lineitem union select 'listed', unnest([1, 2, 3])")
def o138_reconciled_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("class"))
    listed = spark.range(1, 4).select(F.col("id").cast("int").alias("id"), F.lit("listed").alias("name"))
    return u.reconciled_classes(listed, pixels.select(F.col("class").alias("id")).distinct(), pixels)


ITEMS_SQL = """w as (select o_custkey as project, o_orderkey as id from orders),
i as (select o_custkey as project, o_orderkey as id, 'n' || o_orderkey || '.png' as filename from orders where o_orderstatus = 'F'),
f as (select o_custkey as project, case o_orderkey % 3 when 0 then 'n' || o_orderkey || '.png' when 1 then o_orderkey || '.tif' else o_orderkey || '.gif' end as filename from orders)"""


@query(f"""with {ITEMS_SQL} select w.project, w.id, coalesce(a.filename, b.filename) as filename from w left join i on i.project = w.project and i.id = w.id
left join f a on a.project = w.project and a.filename = i.filename left join f b on b.project = w.project and i.filename is null and b.filename = w.id || '.tif'""")
def o139_found_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, t = F.col("o_orderkey").cast("string"), table(spark, sf_dir, "orders")
    named, kind = F.concat(F.lit("n"), key, F.lit(".png")), F.col("o_orderkey") % 3
    wanted = t.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"))
    index = t.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), named.alias("filename"))
    files = t.select(F.col("o_custkey").alias("project"), F.when(kind == 0, named).when(kind == 1, F.concat(key, F.lit(".tif"))).otherwise(F.concat(key, F.lit(".gif"))).alias("filename"))
    return u.found_items(wanted, index, files)


@query("select o_custkey as project, max(o_orderpriority) as name from orders group by 1")
def o139_latest_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.latest_exports(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("name")))


@query("""with f as (select distinct l_suppkey as project, l_partkey as name from lineitem where l_returnflag <> 'R'), i as (select distinct l_suppkey as project, l_partkey as name from lineitem where l_linestatus = 'F')
select coalesce(f.project, i.project) as project, count(*) filter (i.name is null) as added, count(*) filter (f.name is null) as removed, count(*) filter (f.name is not null and i.name is not null) as kept
from f full join i on f.project = i.project and f.name = i.name group by 1""")
def o142_project_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumns({"project": F.col("l_suppkey"), "name": F.col("l_partkey")})
    return u.project_scan(t.where("l_returnflag <> 'R'").select("project", "name"), t.where("l_linestatus = 'F'").select("project", "name"))


@query("select c_custkey as id, coalesce(s_name, c_name) as name, case when s_suppkey is null then 0 else 1000 end::bigint as updated_at from customer left join supplier on c_custkey = s_suppkey")
def o144_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).cast("bigint").alias("updated_at"))
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return u.updated(projects, changes, F.lit(1000).cast("bigint"))
