"""Profile queries: shape, statistics, distributions."""

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.quantiles import number_modes, value_counts
from .registry import query, table

LINEITEM = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
            "l_discount l_tax").split()


def union_all(parts):
    return "\nunion all\n".join(parts)


def mode_sql(tab, col, cast="double"):
    return (f"(select {col}::{cast} from {tab} where {col} is not null "
            f"group by {col} order by count(*) desc, {col} limit 1)")


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


_TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz"}


@query("profile_shape", union_all(
    f"""select '{c}' as "column", case typeof(any_value({c})) {" ".join(f"when '{d}' then '{t}'" for d, t in _TYPES.items())}
    end as type, {i}::int as position, count(*)::bigint as n_rows from orders"""
    for i, c in enumerate("o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split())))
def profile_shape(spark, folder):
    return P.shape(table(spark, folder, "orders"))


EVENTS_GAPS = """(select event_id, ts, user_id, event_type,
  case when event_id % 7 = 0 then null else value end as value,
  case when event_id % 5 = 0 then null else props end as props from events)"""


def events_gaps(spark, folder):
    """events with nulls by rule (the test tables have none)."""
    return table(spark, folder, "events").withColumns({
        "value": F.when(F.col("event_id") % 7 != 0, F.col("value")),
        "props": F.when(F.col("event_id") % 5 != 0, F.col("props"))})


@query("missing_counts", union_all(
    f"""select '{c}' as "column", count_if({c} is null)::bigint as n_missing,
    count(*)::bigint as n_rows from {EVENTS_GAPS}"""
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def missing_counts(spark, folder):
    return P.missing_counts(events_gaps(spark, folder))


@query("profile_numeric", union_all(
    f"""select '{c}' as "column", count({c})::bigint as n, round(avg({c}), 4) as mean,
    round(median({c})::double, 4) as median, {mode_sql('lineitem', c)} as mode,
    round(var_samp({c}) / 1000, 3) as variance_k, round(stddev_samp({c}), 4) as std,
    round(skewness({c}), 4) + 0.0 as skewness, round(kurtosis({c}), 4) + 0.0 as kurtosis
    from lineitem""" for c in LINEITEM))
def profile_numeric(spark, folder):
    out = P.numeric_profile(table(spark, folder, "lineitem"), LINEITEM)
    out = out.withColumn("variance_k", F.round(F.col("variance") / 1000, 3)).drop("variance")
    return _round(out, 4, "mean", "median", "std", "skewness", "kurtosis")


@query("profile_datetime", union_all(
    f"""select '{c}' as "column",
    strftime(make_timestamp(floor(avg(epoch_us({c})))::bigint), '%Y-%m-%d %H:%M:%S') as mean,
    strftime(make_timestamp(floor(median(epoch_us({c})))::bigint), '%Y-%m-%d %H:%M:%S') as median,
    (select strftime({c}, '%Y-%m-%d %H:%M:%S') from {t} group by {c}
     order by count(*) desc, {c} limit 1) as mode from {t}"""
    for t, c in (("lineitem", "l_shipdate"), ("events", "ts"))))
def profile_datetime(spark, folder):
    return (P.datetime_profile(table(spark, folder, "lineitem"), ["l_shipdate"])
            .unionByName(P.datetime_profile(table(spark, folder, "events"), ["ts"])))


@query("profile_categorical", union_all(
    f"""select '{c}' as "column", {mode_sql('part', c, 'varchar')} as mode,
    (select count(*) from part group by {c} order by 1 desc limit 1)::bigint as freq,
    count(distinct {c})::bigint as n_distinct from part"""
    for c in ("p_name", "p_brand", "p_type")))
def profile_categorical(spark, folder):
    return P.categorical_profile(table(spark, folder, "part"))


@query("histogram", """
with e as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem),
b as (select least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9)::int as bin,
      count(*)::bigint n from lineitem, e group by 1)
select i::int as bin, round(lo + i * ((hi - lo) / 10), 2) as lower,
  round(lo + (i + 1) * ((hi - lo) / 10), 2) as upper, coalesce(n, 0)::bigint as n
from range(10) r(i), e left join b on b.bin = i""")
def histogram(spark, folder):
    return _round(P.histogram(table(spark, folder, "lineitem"), "l_extendedprice"),
                  2, "lower", "upper")


@query("quantiles", union_all(
    f"""select '{c}' as "column", q::double as q,
    round(quantile_cont({c}::double, q), 4) as value
    from lineitem, (values (0.0),(0.25),(0.5),(0.75),(1.0)) t(q) group by q"""
    .replace("quantile_cont(%s::double, q)" % c, "CASE q " + " ".join(
        f"WHEN {q} THEN quantile_cont({c}::double, {q})" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + " END")
    for c in LINEITEM))
def quantiles(spark, folder):
    return _round(P.quantile_table(table(spark, folder, "lineitem"), LINEITEM), 4, "value")


@query("value_counts_top10", """
select p_brand as value, count(*)::bigint as n from part group by 1
order by 2 desc, 1 limit 10""")
def value_counts_top10(spark, folder):
    return P.top_values(table(spark, folder, "part"), "p_brand")


def _full_sql():
    parts = []

    def line(column, metric, expr, tab="from part"):
        parts.append(f"""select '{column}' as "column", '{metric}' as metric,
            {expr} as value {tab}""")

    numbers, texts = ("p_partkey", "p_size", "p_retailprice"), ("p_name", "p_brand", "p_type")
    for c in numbers + texts:
        line(c, "n_missing", f"count_if({c} is null)::double")
        line(c, "n_rows", "count(*)::double")
    for c in numbers:
        for m, e in (("mean", f"avg({c})"), ("variance", f"var_samp({c})"),
                     ("std", f"stddev_samp({c})"), ("skewness", f"skewness({c})"),
                     ("kurtosis", f"kurtosis({c})"), ("median", f"median({c})"),
                     ("min", f"min({c})"), ("q25", f"quantile_cont({c}::double, 0.25)"),
                     ("q50", f"median({c})"), ("q75", f"quantile_cont({c}::double, 0.75)"),
                     ("max", f"max({c})")):
            line(c, m, f"round(({e})::double, 3) + 0.0")
        parts.append(f"""select '{c}' as "column", 'mode' as metric, {mode_sql('part', c)} as value""")
    for c in texts:
        line(c, "freq", f"(select count(*) from part group by {c} order by 1 desc limit 1)::double", "")
        line(c, "n_distinct", f"count(distinct {c})::double")
    for c in numbers:
        parts.append(f"""select '{c}', m || (i + 1), round(case m when 'bin_' then coalesce(n, 0)
          when 'lower_' then lo + i * ((hi - lo) / 10) else lo + (i + 1) * ((hi - lo) / 10) end, 3) + 0.0
          from range(10) r(i) cross join (values ('bin_'), ('lower_'), ('upper_')) k(m)
          cross join (select min({c})::double lo, max({c})::double hi from part) e
          left join (select least(floor(({c} - lo) / ((hi - lo) / 10)), 9)::int as b, count(*)::double n
            from part, (select min({c})::double lo, max({c})::double hi from part) group by 1) h on b = i""")
    for c in numbers + texts:
        parts.append(f"""select '{c}', 'top_n_' || p, n::double from (select n, row_number() over (order by n desc) p from
          (select count(*) n from part where {c} is not null group by {c})) where p <= 10""")
    joined = union_all(parts)
    tops = union_all([f"""select '{c}' as "column", 'top_' || p as metric, v as words from (select v, row_number() over
          (order by n desc, v) p from (select {c}::varchar v, count(*) n from part where {c} is not null group by 1))
          where p <= 10""" for c in ("p_partkey", "p_size", *texts)]
                     + [f"""select '{c}', 'mode', {mode_sql('part', c, 'varchar')}""" for c in texts])
    return f"""select "column", metric, value, null::varchar as words from ({joined}) a
      union all select "column", metric, null, words from ({tops}) b"""


@query("full_profile", _full_sql())
def full_profile(spark, folder):
    """Numbers rounded, other values as text; the texts of frequent prices are left to `top_n_`, as engines print doubles differently."""
    long = P.full_profile(table(spark, folder, "part"))
    shown = long.filter(~(F.col("metric").rlike("^top_[0-9]+$") & (F.col("column") == "p_retailprice")))
    plain = F.col("metric").rlike("^top_[0-9]+$") | (
        (F.col("metric") == "mode") & F.col("column").isin("p_name", "p_brand", "p_type"))
    return shown.select("column", "metric",
                        F.when(~plain, F.round(F.col("value").try_cast("double"), 3) + F.lit(0.0)).alias("value"),
                        F.when(plain, F.col("value")).alias("words"))


@query("exact_modes", """
select 'big' as "column", v::varchar as mode, n::bigint as freq from (select l_orderkey + 9007199254740992 as v, count(*) n
  from lineitem group by 1 order by 2 desc, 1 limit 1)
union all select 'price', v::varchar, n from (select l_extendedprice::decimal(18,2) as v, count(*) n
  from lineitem group by 1 order by 2 desc, 1 limit 1)""")
def exact_modes(spark, folder):
    """Modes of integers beyond 2^53 and of decimals, which doubles would merge."""
    return number_modes(table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") + F.lit(9007199254740992)).alias("big"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price")), ["big", "price"])


def _describe_sql():
    parts = []
    for c in ("c_custkey", "c_nationkey", "c_acctbal"):
        parts.append(f"""select '{c}' as "column", count({c})::bigint as "count",
        round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as std, min({c})::double as "min",
        quantile_cont({c}::double, 0.25) as q25, quantile_cont({c}::double, 0.5) as q50,
        quantile_cont({c}::double, 0.75) as q75, max({c})::double as "max",
        null::double as "unique", null::varchar as top, null::double as freq from customer""")
    for c in ("c_name", "c_mktsegment"):
        parts.append(f"""select '{c}', count({c})::bigint, null, null, null, null, null, null, null,
        count(distinct {c})::double, {mode_sql('customer', c, 'varchar')},
        (select count(*) from customer group by {c} order by 1 desc limit 1)::double from customer""")
    parts.append("""select 'rich', count(c_acctbal), null, null, null, null, null, null, null, count(distinct c_acctbal > 5000)::double,
        (select (c_acctbal > 5000)::varchar from customer group by 1 order by count(*) desc, 1 limit 1),
        (select count(*) from customer group by c_acctbal > 5000 order by 1 desc limit 1)::double from customer""")
    parts.append("""select 'opened', count(*), avg(d), stddev_samp(d), min(d), quantile_cont(d, 0.25), quantile_cont(d, 0.5),
        quantile_cont(d, 0.75), max(d), null, null, null
        from (select epoch_us(make_timestamp(c_custkey * 86400000000))::double as d from customer)""")
    inner = union_all(parts)
    return f"""select "column", "count", mean, std, round("min", 3) as "min", round(q25, 3) as q25,
      round(q50, 3) as q50, round(q75, 3) as q75, round("max", 3) as "max", "unique", top, freq
      from ({inner}) d"""


@query("describe_all", _describe_sql())
def describe_all(spark, folder):
    customers = table(spark, folder, "customer").withColumns({
        "rich": F.col("c_acctbal") > 5000, "opened": F.date_from_unix_date(F.col("c_custkey").cast("int"))})
    return _round(P.describe_all(customers), 3,
                  "mean", "std", "min", "q25", "q50", "q75", "max", "unique", "freq")


@query("approx_distinct", union_all(
    f"""select '{c}' as "column", true as close from lineitem having count(*) > 0"""
    for c in LINEITEM))
def approx_distinct(spark, folder):
    """Whether each sketch is within four standard errors of the exact count."""
    lineitem = table(spark, folder, "lineitem").select(*LINEITEM)
    exact = value_counts(lineitem, LINEITEM).groupBy("column").agg(F.count(F.lit(1)).alias("exact"))
    sketch = P.approx_distinct(lineitem, rsd=0.02)
    return sketch.join(exact, "column").select(
        "column", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.08 * F.col("exact")).alias("close"))
