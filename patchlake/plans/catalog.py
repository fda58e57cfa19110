"""Queries of catalogues and lists; projects are nations, banks are customers, images are orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.identity import natural_key
from patchlake.operators import catalog as c
from patchlake.plans.registry import query
from patchlake.sources.shared import table


@query("""with b as (select c_custkey, c_nationkey as project, count(o_orderkey) as images, count(*) filter (o_orderstatus = 'F') as labelled, count(*) filter (o_orderstatus = 'P') as staged, case when c_nationkey % 2 = 0 then c_mktsegment else 'store' end as basis from customer left join orders on c_custkey = o_custkey group by all)
select project, sum(images)::bigint as images, sum(labelled)::bigint as labelled, sum(staged)::bigint as staged, case when count(distinct basis) = 1 then min(basis) else 'mixed' end as basis from b group by 1""")
def o80_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    basis = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise("store")
    banks = both.groupBy("c_custkey", F.col("c_nationkey").alias("project"), basis.alias("basis")).agg(F.count("o_orderkey").alias("images"), F.count_if(F.col("o_orderstatus") == "F").alias("labelled"), F.count_if(F.col("o_orderstatus") == "P").alias("staged"))
    return c.census(banks)


@query("select p_partkey * 3 as name, s_name from part left join supplier on p_partkey * 3 = s_suppkey")
def o96_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("name"))
    return c.reconciled(files, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), "s_name"))


@query("select coalesce(p_partkey, s_suppkey) as name, case when s_suppkey is null then 'added' when p_partkey is null then 'removed' else 'kept' end as change from (select p_partkey * 3 as p_partkey from part) full join supplier on p_partkey = s_suppkey")
def o97_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("name"))
    return c.sync_changes(files, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name")))


@query("select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P'")
def o98_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.where("o_orderstatus = 'F'").select("o_custkey").subtract(t.where("o_orderstatus = 'P'").select("o_custkey"))


@query("select coalesce(max(c_name) filter (c_name = 'Customer#000000007'), min(c_name), 'default') as c_name from customer")
def o128_o134_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chosen(table(spark, sf_dir, "customer"), "Customer#000000007", "c_name", "default")


@query("select c_mktsegment, string_agg(distinct c_nationkey::varchar, ',' order by c_nationkey::varchar) as labels from customer where c_acctbal > 0 group by 1")
def o129_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("label"))
    return t.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))  # labels of a bank are few


@query("select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as run, max(o_totalprice) as f1 from orders where o_orderstatus <> 'P' group by 1")
def o143_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("run"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("f1"), (F.col("o_orderstatus") != "P").alias("has_model"))
    return c.best_run(t, "o_custkey")


@query("select o_custkey, arg_min(o_orderkey, (o_orderstatus <> 'P', o_orderkey)) as run from orders group by 1")
def o162_default_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("run"), F.col("o_orderkey").alias("position"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    return c.default_run(t, "o_custkey")


@query("select o_orderkey as run, case when o_orderstatus = 'P' then 'failed' else o_orderstatus end as status from orders where o_orderkey in (select l_orderkey from lineitem)")
def o141_swept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "P", "running").otherwise(F.col("o_orderstatus")).alias("status"))
    return c.swept_runs(runs, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run")))


@query("select count(*) as images, count(distinct o_custkey) as stems, min(o_orderkey) as first from orders")
def o145_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("images"), F.countDistinct("o_custkey").alias("stems"), F.min("o_orderkey").alias("first"))


@query("select count(*) as files, sum(l_quantity * 1000)::bigint as bytes, count(*) filter (l_linenumber = 1) as outside, false as accepted from lineitem")
def o148_upload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 1, "../up.png").when(F.col("l_linenumber") == 2, "a..b.png").otherwise("in/ok.png")
    t = table(spark, sf_dir, "lineitem").select(name.alias("name"), (F.col("l_quantity") * 1000).cast("bigint").alias("bytes"))
    return c.upload_guard(t, 1 << 40, 1 << 50)


NAMES_SQL = "'IMG' || (p_partkey % 120) || '_v' || p_size"


@query(f"""with n as (select p_partkey, {NAMES_SQL} as name, case when p_size % 4 > 0 then p_retailprice end as score, p_brand from part)
select p_partkey, row_number() over (partition by p_brand order by regexp_extract(name, 'IMG(\\d+)', 1)::int, regexp_extract(name, '_v(\\d+)', 1)::int, p_partkey) as by_name, row_number() over (partition by p_brand order by score desc nulls last, p_partkey) as by_score from n""")
def o156_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in lists sorted by natural name and by score with unscored last; a list for each brand."""
    from pyspark.sql import Window

    name = F.concat(F.lit("IMG"), (F.col("p_partkey") % 120).cast("string"), F.lit("_v"), F.col("p_size").cast("string"))
    t = table(spark, sf_dir, "part").select("p_partkey", "p_brand", name.alias("name"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).alias("score"))
    place = lambda *order: F.row_number().over(Window.partitionBy("p_brand").orderBy(*order))
    return t.select("p_partkey", place(natural_key(F.col("name")), F.asc("p_partkey")).alias("by_name"), place(c.sort_columns("-score")[0], F.asc("p_partkey")).alias("by_score"))


@query("select distinct unnest(string_split(p_name, ' ')) as tag from part")
def o157_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()


@query("select p_partkey from part where list_has_any(string_split(p_name, ' '), ['red', 'small']) and not list_has_any(string_split(p_name, ' '), ['ring'])")
def o158_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(c.tag_filter(F.split("p_name", " "), ["red", "small"], ["ring"])).select("p_partkey")


@query("""with n as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as i from orders),
e as (select o_custkey, min(i) as a, max(i) as b from n where o_orderkey % 5 = 0 or o_orderkey % 7 = 0 group by 1) select n.o_custkey, o_orderkey from n join e using (o_custkey) where i between a and b""")
def o164_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return c.ranged(t, [F.asc("o_totalprice"), F.asc("o_orderkey")], F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 7 == 0, "o_custkey").select("o_custkey", "o_orderkey")


@query("select r_name, n_name, count(c_custkey) as banks, round(sum(c_acctbal), 2) as total from region join nation on r_regionkey = n_regionkey left join customer on n_nationkey = c_nationkey group by rollup (r_name, n_name)")
def o15_catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, nations, customers = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    both = regions.join(F.broadcast(nations), F.col("r_regionkey") == F.col("n_regionkey")).join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")  # 25 rows
    return both.rollup("r_name", "n_name").agg(F.count("c_custkey").alias("banks"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""with w as (select o_orderkey as id, o_custkey as entry, o_orderpriority as name, o_orderstatus as tier from orders), f as (select c_name as path, case when c_custkey % 2 = 0 then c_custkey end as entry, case when c_custkey = 11 then '5-LOW' else c_mktsegment end as name, case c_nationkey % 3 when 0 then 'F' when 1 then 'O' else 'P' end as tier from customer)
select id, coalesce((select min(path) from f where f.entry = w.entry), (select min(path) from f where f.name = w.name and f.tier = w.tier), (select min(path) from f where f.name = w.name having count(*) = 1)) as path from w""")
def o59_resolved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entry"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("tier"))
    kind = F.col("c_nationkey") % 3
    files = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("entry"), F.when(F.col("c_custkey") == 11, "5-LOW").otherwise(F.col("c_mktsegment")).alias("name"), F.when(kind == 0, "F").when(kind == 1, "O").otherwise("P").alias("tier"))
    return c.resolved_images(wanted, files).select("id", "path")


@query("select o_orderstatus as tier, o_orderpriority as label, o_custkey as entry, count(*) as rows from orders group by all")
def o126_bank_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.bank_listing(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("entry")))


@query("select c_custkey as entry, case when s_suppkey is not null then trim(s_name) else c_mktsegment end as grp from customer left join supplier on c_custkey = s_suppkey")
def o130_set_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry"), F.col("c_mktsegment").alias("grp"))
    return c.set_groups(images, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entry"), F.concat(F.lit(" "), "s_name").alias("grp")))[0]


@query("""with r as (select l_returnflag as tier, l_linestatus as label, count(*) as rows from lineitem group by all), i as (select l_returnflag as tier, l_linestatus as label, count(*) as covered from lineitem where l_suppkey % 3 > 0 group by all)
select tier, label, rows, coalesce(covered, 0) as covered, rows - coalesce(covered, 0) as uncovered from r left join i using (tier, label)""")
def o133_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tier"), F.col("l_linestatus").alias("label"), F.col("l_suppkey").alias("entry"))
    return c.coverage(bank, bank.where("entry % 3 > 0").groupBy("tier", "label", "entry").agg(F.count("*").alias("count")))


@query("""select 'ghost' as kind, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_custkey % 4 > 0) union all
select 'orphan_mask', count(*) from supplier where s_suppkey not in (select c_custkey from customer where c_custkey % 4 > 0) union all
select 'wrong_flag', count(*) from orders where (o_orderstatus = 'F') <> (o_custkey in (select s_suppkey from supplier))""")
def o140_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderstatus") == "F").alias("has_mask"))
    files = table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("name"))
    return c.integrity(index, files, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name")))


@query("select coalesce(max(coalesce(p_size, 0)) + 1, 2) as n from part")
def o147_n_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.n_classes(table(spark, sf_dir, "part").select(F.col("p_size").alias("id")))


@query("select o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as newest, o_orderkey from orders")
def o159_project_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in each owner's list of projects, newest first."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("name"))
    return t.select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*c.project_order("newest"))).alias("newest"), "o_orderkey")


@query("select c_custkey, greatest(60, least(100, coalesce(case when c_acctbal > 0 then floor(c_acctbal)::bigint % 140 end, 90)))::bigint as quality from customer")
def o146_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal") % 140)
    t = table(spark, sf_dir, "customer").select("c_custkey", quality.alias("quality"))
    return c.with_defaults(t, {"quality": 90}, {"quality": (60, 100)}).select("c_custkey", F.col("quality").cast("bigint").alias("quality"))
