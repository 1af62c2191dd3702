"""Queries on neighbours: imputation, outlier factors, isolation, oversampling."""

from pyspark.sql import functions as F

from ..operators import isolation as I
from ..operators import neighbors as N
from .registry import query, table

GAPS = """(select c_custkey, case when c_custkey % 5 = 0 then null else c_acctbal end as a,
  case when c_custkey % 4 = 1 then null else (c_nationkey * 400)::double end as b from customer)"""


def _gaps(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("a"),
        F.when(F.col("c_custkey") % 4 != 1, (F.col("c_nationkey") * 400).cast("double")).alias("b"))


def _fill_sql(target, other):
    return f"""coalesce(d.{target}, (select avg(v) from (select e.{target} as v from {GAPS} e
      where d.{target} is null and e.{target} is not null and e.{other} is not null and d.{other} is not null
      order by abs(e.{other} - d.{other}), e.c_custkey limit 3)), (select avg({target}) from {GAPS}))"""


@query("impute_knn", f"""
select c_custkey, round({_fill_sql('a', 'b')}, 4) as a, round({_fill_sql('b', 'a')}, 4) as b from {GAPS} d""")
def impute_knn(spark, folder):
    out = N.knn_impute(_gaps(spark, folder), ["a", "b"], ["c_custkey"], 3)
    return out.select("c_custkey", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


_LOF = """
with s as (select s_suppkey as id, s_acctbal as x, (s_nationkey * 400)::double as y from supplier),
d as (select a.id, b.id as o, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist,
  row_number() over (partition by a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) as r
  from s a join s b on a.id <> b.id),
n as (select * from d where r <= 20), k as (select id, max(dist) as kd from n group by 1),
l as (select n.id, 1.0 / (avg(greatest(kd, dist)) + 1e-10) as lrd from n join k on k.id = n.o group by 1)
select n.id as s_suppkey, round(avg(lo.lrd) / min(l.lrd), 4) as lof from n join l on l.id = n.id
join l lo on lo.id = n.o group by 1"""


def _suppliers(spark, folder):
    return table(spark, folder, "supplier").select(
        "s_suppkey", "s_acctbal", (F.col("s_nationkey") * 400).cast("double").alias("place"))


@query("lof_scores", _LOF)
def lof_scores(spark, folder):
    out = N.local_outlier_factor(_suppliers(spark, folder), ["s_suppkey"], ["s_acctbal", "place"])
    return out.withColumn("lof", F.round("lof", 4))


@query("anomaly_lof", f"""
select s_suppkey, 'combined' as "column", lof as score, lof as severity from ({_LOF}) where lof > 1.2""")
def anomaly_lof(spark, folder):
    out = N.lof_anomalies(_suppliers(spark, folder), ["s_suppkey"], ["s_acctbal", "place"], threshold=1.2)
    return out.withColumns({c: F.round(c, 4) for c in ("score", "severity")})


@query("anomaly_isolation_forest")
def anomaly_isolation_forest(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    return I.isolation_anomalies(raw, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                                 ["l_quantity", "l_extendedprice", "l_discount"], 0.6)


@query("oversample_smote", """
with d as (select quality, l.n_chars, l.words from (select quality, n_chars, len(string_split(text, ' ')) as words from labels
    join documents using (doc_id)) l),
c as (select quality, count(*) as n, max(count(*)) over () as most from d group by 1)
select quality, false as synthetic, n::bigint as n, n::bigint as in_range from c union all
select quality, true, (most - n)::bigint, (most - n)::bigint from c where n < most and n > 1""")
def oversample_smote(spark, folder):
    """Rows by class and origin, and how many of them lie within the ranges of their class."""
    labels = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("words")), "doc_id")
    ranges = labels.groupBy(F.col("quality").alias("q")).agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("n_chars", "words") for f in (F.min, F.max)])
    out = N.smote(labels, "quality", ["n_chars", "words"], ["doc_id"]).join(F.broadcast(ranges), F.col("quality") == F.col("q"))
    inside = F.col("n_chars").between(F.col("min_n_chars"), F.col("max_n_chars")) & F.col("words").between(
        F.col("min_words"), F.col("max_words"))
    return out.groupBy("quality", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("in_range"))
