"""Queries of the bank over time: hits, decay, sizes, annotation, intervals, exemplars, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.operators import assembly as a
from patchlake.operators import memory as m
from patchlake.operators.evaluation import top_rows
from patchlake.operators.exemplars import exemplar_distances, exemplar_rows
from patchlake.operators.ordered import merged_intervals, totals_before
from patchlake.plans.binding import NOW, ROWS_SQL, bank_rows
from patchlake.plans.evaluation import scored_rows
from patchlake.plans.registry import query
from patchlake.sources.shared import materialise, table

FRESH_SQL = f"exp(-greatest({NOW} - last_hit, 0) / [100.0, 1000.0, 10000.0][memory + 1])"


@query("""with s as (select o_custkey * 1000 + o_orderkey % 977 - 5 as a, o_orderkey % 90 as n from orders), c as (select greatest(a, 0) as a, least(a + n, 1000000) as b from s),
o as (select a, b, max(b) over (order by a, b rows between unbounded preceding and 1 preceding) as reached from c where b > a),
g as (select a, b, sum(case when reached is null or a > reached then 1 else 0 end) over (order by a, b rows unbounded preceding) as island from o)
select min(a) as start, max(b) - min(a) as count from g group by island""")
def o48_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 1000 + F.col("o_orderkey") % 977 - 5).alias("start"), (F.col("o_orderkey") % 90).alias("count"))
    return merged_intervals(t, limit=F.lit(1_000_000))


@query("select o_orderkey, coalesce(sum(n) over (order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as start, n as count from (select o_orderkey, 1 + o_custkey % 50 as n from orders)")
def o91_row_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_custkey") % 50).alias("count"))
    return totals_before(t, "o_orderkey", {"start": F.col("count")}).select("o_orderkey", "start", "count")


@query(f"with {ROWS_SQL} select tier, label, count(*) as rows from bank group by rollup (tier, label)")
def o78_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.sizes(bank_rows(spark, sf_dir))


@query("select count(*) as rows, least(100.0, round_even(count(*) / 350000.0 * 100, 1))::double as pct, round(count(*) * 64 * 2 / 1048576.0)::bigint as mb from lineitem")
def o78_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.capacity(table(spark, sf_dir, "lineitem").select("l_orderkey"), 350_000, 64)


@query(f"""with {ROWS_SQL}, k as (select vec_id, case when entry % 2 = 0 and tier <> 'normal' then case when row in (1, 4) then 3 when row = 7 then 1 else 2 end else severity end as severity from bank) select vec_id, severity::bigint as severity from k""")
def o102_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    picked = rows.where("entry % 2 = 0 and tier <> 'normal' and row in (1, 4, 7)")
    return m.annotate(rows, picked.select("entry", "row", F.when(F.col("row") == 7, 0).otherwise(9).alias("severity"))).select("vec_id", F.col("severity").cast("bigint").alias("severity"))


@query(f"with {ROWS_SQL} select tier, label, count(*) as rows, sum(vec_id)::bigint as ids from bank where entry % 7 <> 2 and not (tier = 'critical' and label = 'd1') group by all")
def o103_o104_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    left = m.clear(m.remove(rows, rows.where("entry % 7 = 2").select("entry").distinct()), "critical", "d1")
    return left.groupBy("tier", "label").agg(F.count("*").alias("rows"), F.sum("vec_id").alias("ids"))


HIT_SQL = f"with {ROWS_SQL}, named as (select distinct event_id + event_id // 2 as vec_id from events) select vec_id, case when tier <> 'normal' and vec_id in (from named) then {NOW} else last_hit end as last_hit, hit_count + case when tier <> 'normal' and vec_id in (from named) then 1 else 0 end as hit_count from bank"


@query(HIT_SQL)
def o106_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rows lie anywhere in the bank, two of each three."""
    rows = bank_rows(spark, sf_dir)
    named = table(spark, sf_dir, "events").select((F.col("event_id") + F.floor(F.col("event_id") / 2)).alias("vec_id"))
    return m.hit(rows, rows.where("tier <> 'normal'").join(named, "vec_id"), NOW).select("vec_id", "last_hit", "hit_count")


@query(HIT_SQL)
def o106_hit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older name of `o106_hit`."""
    return o106_hit(spark, sf_dir)


@query(f"with {ROWS_SQL} select tier, label, count(*) filter (memory = 0 and hit_count >= 3) as to_mid, count(*) filter (memory = 1 and hit_count >= 10) as to_long, count(*) filter (memory = 0 and {FRESH_SQL} < 0.05) as retire from bank where tier <> 'normal' group by all")
def o107_decay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.decay_counts(bank_rows(spark, sf_dir), NOW)


@query(f"with {ROWS_SQL} select vec_id, case when tier <> 'normal' and memory = 0 and hit_count >= 3 then 1 when tier <> 'normal' and memory = 1 and hit_count >= 10 then 2 else memory end::bigint as memory from bank where not (tier <> 'normal' and memory = 0 and {FRESH_SQL} < 0.05)")
def o107_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.decay(bank_rows(spark, sf_dir), NOW).select("vec_id", F.col("memory").cast("bigint").alias("memory"))


BUDGET_SQL = "sized as (select c_nationkey as grp, o_custkey as entry, count(*) as rows from orders join customer on o_custkey = c_custkey group by all)"


@query(f"""with recursive {BUDGET_SQL}, placed as (select *, row_number() over (partition by grp order by rows, entry) as i, count(*) over (partition by grp) as n, sum(rows) over (partition by grp) as total from sized),
filled as (
  select grp, entry, rows, i, n, case when total <= 400 then rows else least(rows, greatest(1, 400 // n)) end as budget, 400 - least(rows, greatest(1, 400 // n)) as remaining from placed where i = 1
  union all
  select p.grp, p.entry, p.rows, p.i, p.n, case when total <= 400 then p.rows else least(p.rows, greatest(1, remaining // (p.n - p.i + 1))) end, remaining - least(p.rows, greatest(1, remaining // (p.n - p.i + 1))) from filled f join placed p on p.grp = f.grp and p.i = f.i + 1)
select grp, entry, rows, budget::bigint as budget from filled""")
def o108_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return a.budgets(both.groupBy(F.col("c_nationkey").alias("grp"), F.col("o_custkey").alias("entry")).agg(F.count("*").alias("rows")), 400, ("grp",))


@query("""with w as (select o_orderkey as position, 1 + o_custkey % 60 as rows from orders), b as (select *, least(rows, 40) as want, coalesce(sum(least(rows, 40)) over (order by position rows between unbounded preceding and 1 preceding), 0) as before from w)
select position, rows, least(want, greatest(0, 200000 - 1234 - before))::bigint as taken from b""")
def o114_taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), (1 + F.col("o_custkey") % 60).alias("rows"))
    return a.taught(t, 1234, 200_000, 40)


SCORES_SQL = """near as (select q.vec_id, list_distance(q.vec, b.vec) as d, row_number() over (partition by q.vec_id order by list_distance(q.vec, b.vec)) as r from bank q join (select * from bank where tier = 'normal') b on q.entry <> b.entry where q.tier = 'critical'),
scored as (select vec_id, avg(d) as score from near where r <= 5 group by 1), hot as (select b.*, score, row_number() over (partition by b.entry order by score desc, b.row) as rank from bank b join scored s on b.vec_id = s.vec_id),
exemplars as (select * from bank where tier = 'critical' and entry % 2 = 0 and severity = 3 union all by name select * exclude (score, rank) from hot where entry % 2 = 1 and rank <= 4)"""


def exemplar_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Critical rows, their scores, and the exemplars: heavy rows of annotated (even) entries, hottest rows of the others."""
    rows = bank_rows(spark, sf_dir).where("tier = 'critical'").withColumn("annotated", F.col("entry") % 2 == 0)
    scores = materialise(scored_rows(spark, sf_dir, "tier = 'critical'").select("entry", "row", "score"), "scores")
    return rows, scores, exemplar_rows(rows, scores, 4)


@query(f"with {ROWS_SQL}, {SCORES_SQL} select vec_id, entry from exemplars")
def o54_o56_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exemplar_tables(spark, sf_dir)[2].select("vec_id", "entry")


@query(f"""with {ROWS_SQL}, {SCORES_SQL} select h.vec_id, h.rank::int as rank, round(min(list_distance(h.vec, e.vec)), 6) as cmin from hot h join exemplars e on h.entry <> e.entry where h.rank <= 6 group by all""")
def o55_cmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scores, exemplars = exemplar_tables(spark, sf_dir)
    hot = top_rows(scores, ("entry",), "row", 6).join(rows.select("entry", "row", "vec_id", "vec"), ["entry", "row"])
    return exemplar_distances(hot.select("vec_id", "entry", "rank", "vec"), exemplars).select("vec_id", F.col("rank").cast("int").alias("rank"), F.round("cmin", 6).alias("cmin"))


@query(f"""with {ROWS_SQL}, c as (select tier, label, entry, severity, count(*) as n from bank where tier <> 'normal' group by all),
r as (select tier, label, entry, arg_max(severity, (n, -severity)) filter (severity <> 3) as common from c group by all)
select r.tier, r.label, r.entry, coalesce(common, 3)::bigint as severity, case when common is null then 0 else (select count(*) from bank b where b.entry = r.entry and b.severity = 3) end as n_marks from r""")
def o111_base_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir).where("tier <> 'normal'")
    return a.base_severity(rows).select("tier", "label", "entry", F.col("severity").cast("bigint").alias("severity"), F.size("marks").cast("bigint").alias("n_marks"))


@query(f"""with {ROWS_SQL}, b as (select tier, label, entry, row, vec, case when vec_id % 50 = 3 then 1 else severity end as severity from bank where vec_id % 41 <> 0)
select coalesce(a.tier, b.tier) as tier, coalesce(a.label, b.label) as label, count(*) filter (b.row is null) as only_first, count(*) filter (a.row is null) as only_second, 0::bigint as vectors, count(*) filter (a.severity <> b.severity) as severities
from bank a full join b using (entry, row) group by all having only_first + severities > 0""")
def o87_bank_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir)
    other = rows.where("vec_id % 41 <> 0").withColumn("severity", F.when(F.col("vec_id") % 50 == 3, 1).otherwise(F.col("severity")))
    return a.bank_diff(rows, other)


@query(f"""with {ROWS_SQL}, prev as (select tier, label, entry, row, severity + 10 as severity, hit_count + 100 as hit_count from bank where entry % 3 = 0 and not (entry % 2 = 0 and row = 9))
select b.vec_id, case when b.entry % 3 = 0 and b.entry % 2 = 1 then p.severity else b.severity end as severity, case when b.entry % 3 = 0 and b.entry % 2 = 1 then p.hit_count else b.hit_count end as hit_count from bank b left join prev p on p.entry = b.entry and p.row = b.row""")
def o51_carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_rows(spark, sf_dir).withColumn("name", F.concat(F.lit("img"), F.col("entry").cast("string"))).withColumn("registered_at", F.lit(0).cast("bigint"))
    before = rows.where("entry % 3 = 0 and not (entry % 2 = 0 and row = 9)").withColumns({"severity": F.col("severity") + 10, "hit_count": F.col("hit_count") + 100})
    before = before.withColumn("entry", F.when(F.col("entry") % 9 != 3, F.col("entry")))  # some of them from before entries had ids
    return m.carried_over(rows, before).select("vec_id", "severity", "hit_count")
