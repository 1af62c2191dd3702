"""Queries on anomalies, associations, KPIs, personal data and cleaning runs."""

from pyspark.sql import functions as F

from ..operators import anomalies as A
from ..operators import correlate as C
from ..operators import kpi as B
from ..operators import pii as X
from ..operators import profile as P
from .profiling import EVENTS_GAPS, events_gaps, union_all
from .registry import query, table
from .steps import CleaningSteps

COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ROW_ID = ROW.split(", ")


def _rounded(df, digits=4, columns=("score", "severity")):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _z(c, t, sd="stddev_pop"):
    return f"abs({c} - (select avg({c}) from {t})) / (select {sd}({c}) from {t})"


@query("anomaly_zscore", f"""
select event_id, 'value' as "column", round(z, 4) as score, round(z, 4) as severity
from (select event_id, {_z('value', EVENTS_GAPS)} as z from {EVENTS_GAPS}) where z > 2.5""")
def anomaly_zscore(spark, folder):
    return _rounded(A.zscore_anomalies(events_gaps(spark, folder), ["event_id"], ["value"],
                                       {"value": 2.5}))


@query("anomaly_zscore_sample", f"""
select event_id, 'value' as "column", round(z, 4) as score, round(z, 4) as severity
from (select event_id, {_z('value', EVENTS_GAPS, 'stddev_samp')} as z from {EVENTS_GAPS}) where z > 3""")
def anomaly_zscore_sample(spark, folder):
    return _rounded(A.zscore_anomalies(events_gaps(spark, folder), ["event_id"], ["value"], ddof=1))


@query("anomaly_zscore_combined", f"""
with z as (select event_id, {_z('value', EVENTS_GAPS)} as a, {_z('user_id', EVENTS_GAPS)} as b
  from {EVENTS_GAPS}), m as (select event_id, greatest(a, b) as z from z where a is not null)
select event_id, c as "column", round(z, 4) as score, round(z, 4) as severity
from m, (values ('value'), ('user_id')) t(c) where z > 2.5""")
def anomaly_zscore_combined(spark, folder):
    return _rounded(A.zscore_anomalies(events_gaps(spark, folder), ["event_id"],
                                       ["value", "user_id"], 2.5, mode="combined"))


def _fence(c, t):
    q = f"(select quantile_cont({c}, {{}}) from {t})"
    q1, q3 = q.format(0.25), q.format(0.75)
    return f"{q1} - 1.5 * ({q3} - {q1})", f"{q3} + 1.5 * ({q3} - {q1})", f"({q3} - {q1})"


_LO, _HI, _IQR = _fence("value", EVENTS_GAPS)


@query("anomaly_iqr", f"""
select event_id, 'value' as "column", value as score,
  round(greatest(abs(value - lo), abs(value - hi)) / (iqr + 1e-9), 4) as severity
from {EVENTS_GAPS}, (select {_LO} as lo, {_HI} as hi, {_IQR} as iqr) b
where value < lo or value > hi""")
def anomaly_iqr(spark, folder):
    return _rounded(A.iqr_anomalies(events_gaps(spark, folder), ["event_id"], ["value"]))


_LO2, _HI2, _ = (x.replace("1.5", "0.3") for x in _fence("l_extendedprice", "lineitem"))
_LO3, _HI3, _ = (x.replace("1.5", "0.3") for x in _fence("l_quantity", "lineitem"))


@query("anomaly_iqr_combined", f"""
with b as (select {_LO2} as lo, {_HI2} as hi, {_LO3} as lo2, {_HI3} as hi2),
s as (select {ROW}, (l_extendedprice < lo or l_extendedprice > hi)::int
  + (l_quantity < lo2 or l_quantity > hi2)::int as s from lineitem, b)
select {ROW}, c as "column", s::double as score, s / 2.0 as severity
from s, (values ('l_extendedprice'), ('l_quantity')) t(c) where s > 0""".replace("s / 2.0", "(s / 2.0)::double"))
def anomaly_iqr_combined(spark, folder):
    return _rounded(A.iqr_anomalies(table(spark, folder, "lineitem"), ROW_ID,
                                    ["l_extendedprice", "l_quantity"], 0.3, mode="combined"))


@query("cleaning_iqr_flags", f"""
select event_id, coalesce(value < lo or value > hi, false) as value_anomaly,
  false as user_id_anomaly, false as event_id_anomaly
from {EVENTS_GAPS}, (select {_LO} as lo, {_HI} as hi) b""")
def cleaning_iqr_flags(spark, folder):
    return A.iqr_flags(events_gaps(spark, folder)).select(
        "event_id", "value_anomaly", "user_id_anomaly", "event_id_anomaly")


# -- association ---------------------------------------------------------------------------
def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def _pearson_sql(columns, source="lineitem"):
    return union_all(f"select '{a}' as c1, '{b}' as c2, round(corr({a}, {b}), 4) + 0.0 as r from {source}"
                     for a, b in _pairs(columns))


_RANKED = "(select " + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}"
    for c in COLS) + " from lineitem)"


def _tau_sql(a, b):
    return f"""select '{a}' as c1, '{b}' as c2, (select round((2 * d.s) / (2 * sqrt(1.0 * (p - tx)) * sqrt(1.0 * (p - ty))), 4) + 0.0
    from (select sum(c1.n * c2.n * sign(c1.x - c2.x) * sign(c1.y - c2.y)) / 2.0 as s
          from (select {a} x, {b} y, count(*) n from lineitem group by 1, 2) c1,
               (select {a} x, {b} y, count(*) n from lineitem group by 1, 2) c2) d,
         (select count(*) * (count(*) - 1) / 2.0 as p from lineitem),
         (select sum(n * (n - 1) / 2.0) as tx from (select count(*) n from lineitem group by {a})),
         (select sum(n * (n - 1) / 2.0) as ty from (select count(*) n from lineitem group by {b}))) as r"""


LOW = ("l_quantity", "l_discount", "l_tax")


@query("corr_pearson", _pearson_sql(COLS))
def corr_pearson(spark, folder):
    return _rounded(C.pearson(table(spark, folder, "lineitem"), COLS), 4, ["r"])


@query("corr_spearman", _pearson_sql(COLS, _RANKED))
def corr_spearman(spark, folder):
    return _rounded(C.spearman(table(spark, folder, "lineitem"), COLS), 4, ["r"])


@query("corr_kendall", union_all(_tau_sql(a, b) for a, b in _pairs(LOW)))
def corr_kendall(spark, folder):
    return _rounded(C.kendall(table(spark, folder, "lineitem"), LOW), 4, ["r"])


_EXACT_TAU = """select '{a}' as c1, '{b}' as c2, round((p - tx - ty + txy - 2 * d) / (sqrt(p - tx) * sqrt(p - ty)), 6) + 0.0 as r from
  (select (count(*) * (count(*) - 1) / 2)::double as p from {t}),
  (select sum(n * (n - 1) / 2)::double as tx from (select count(*) n from {t} group by {a})),
  (select sum(n * (n - 1) / 2)::double as ty from (select count(*) n from {t} group by {b})),
  (select sum(n * (n - 1) / 2)::double as txy from (select count(*) n from {t} group by {a}, {b})),
  (select count(*)::double as d from {t} u join {t} v on u.{a} < v.{a} and u.{b} > v.{b})"""
_PRICES = ("c_custkey", "c_acctbal", "c_nationkey")


@query("corr_kendall_wide", union_all(_EXACT_TAU.format(a=a, b=b, t="customer") for a, b in _pairs(_PRICES)))
def corr_kendall_wide(spark, folder):
    """Columns in which nearly every value is another one."""
    return _rounded(C.kendall(table(spark, folder, "customer"), _PRICES), 6, ["r"])


@query("crosstab", """
select p_brand, p_type, count(*)::bigint as n from part group by 1, 2""")
def crosstab(spark, folder):
    return C.crosstab(table(spark, folder, "part"), "p_brand", "p_type")


def _cramer_sql(a, b, mode):
    cell = f"(select {a} x, {b} y, count(*) n from part group by 1, 2)"
    if mode == "independence":
        chi = (f"select sum((coalesce(c.n, 0) - r.n * k.n * 1.0 / t.t) ** 2 / (r.n * k.n * 1.0 / t.t)) as chi2, "
               "min(t.t) as t from r cross join k cross join t left join c on c.x = r.x and c.y = k.y")
    else:
        chi = ("select sum((coalesce(c.n, 0) - k.n * 1.0 / rr) ** 2 / (k.n * 1.0 / rr)) as chi2, min(t.t) as t "
               "from r cross join k cross join t cross join (select count(*) rr from r) "
               "left join c on c.x = r.x and c.y = k.y")
    return f"""select '{a}' as c1, '{b}' as c2, (with c as {cell}, r as (select x, sum(n) n from c group by 1),
      k as (select y, sum(n) n from c group by 1), t as (select sum(n) t from c), s as ({chi})
      select round(sqrt(chi2 / (t * (least((select count(*) from r), (select count(*) from k)) - 1))), 4)
      from s) as r"""


PART_TEXT = ("p_name", "p_brand", "p_type")


@query("cramers_v", union_all(_cramer_sql(a, b, "independence") for a, b in _pairs(PART_TEXT)))
def cramers_v(spark, folder):
    return _rounded(C.cramers_v(table(spark, folder, "part"), PART_TEXT), 4, ["r"])


@query("cramers_v_colmean", union_all(_cramer_sql(a, b, "column_mean") for a, b in _pairs(PART_TEXT)))
def cramers_v_colmean(spark, folder):
    return _rounded(C.cramers_v(table(spark, folder, "part"), PART_TEXT, "column_mean"), 4, ["r"])


@query("multicollinear", """
with p as (select corr(p_partkey, p_retailprice) a, corr(p_partkey, p_size) b,
  corr(p_retailprice, p_size) c from part),
l as (select 'p_partkey' as feature, 'p_retailprice' as other, a as r from p union all
  select 'p_retailprice', 'p_partkey', a from p union all select 'p_partkey', 'p_size', b from p
  union all select 'p_size', 'p_partkey', b from p union all select 'p_size', 'p_retailprice', c
  from p union all select 'p_retailprice', 'p_size', c from p)
select feature, string_agg(other, ',' order by other) as others from l where abs(r) >= 0.1 group by 1""")
def multicollinear(spark, folder):
    pairs = C.pearson(table(spark, folder, "part"), ["p_partkey", "p_size", "p_retailprice"])
    return C.multicollinear(pairs, 0.1).withColumn("others", F.array_join("others", ","))


_RANK3 = "(select " + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}"
    for c in LOW) + " from lineitem)"


@query("rank_dependencies", "select c1 as feature_1, c2 as feature_2, round(abs(r), 4) as score, method from ("
       + "select *, 'pearson' as method from (" + _pearson_sql(LOW) + ") union all "
       + "select *, 'spearman' from (" + _pearson_sql(LOW, _RANK3) + ") union all "
       + "select *, 'kendall' from (" + union_all(_tau_sql(a, b) for a, b in _pairs(LOW)) + ") union all "
       + "select *, 'cramers_v' from (" + _cramer_sql("l_returnflag", "l_linestatus", "independence").replace("from part", "from lineitem")
       + ")) order by 3 desc, 1, 2, 4 limit 20")
def rank_dependencies(spark, folder):
    return C.rank_dependencies(table(spark, folder, "lineitem"), LOW, ["l_returnflag", "l_linestatus"])


# -- KPIs ----------------------------------------------------------------------------------
def _kpi_sql(rows, source):
    return union_all(f"select '{n}' as kpi, round(({e})::double, 4) as value from {source}" for n, e in rows)


@query("kpi_finance", _kpi_sql([
    ("Total Revenue", "sum(l_extendedprice)"), ("Net Profit", "sum(l_extendedprice * l_discount)"),
    ("Profit Margin", "sum(l_extendedprice * l_discount) / sum(l_extendedprice)"),
    ("Return on Assets", "sum(l_extendedprice * l_tax) / sum(l_quantity)")], "lineitem"))
def kpi_finance(spark, folder):
    raw = table(spark, folder, "lineitem").selectExpr(
        "l_extendedprice as Revenue", "l_extendedprice * l_discount as net_profit",
        "l_extendedprice * l_tax as net_income", "l_quantity as total_assets")
    return _rounded(B.kpis(raw, "Finance"), 4, ["value"])


@query("kpi_healthcare", _kpi_sql([
    ("Patient Count", "count(distinct o_custkey)"), ("Average Stay", "avg(o_orderkey % 11)"),
    ("Readmission Rate", "sum((o_orderstatus = 'F')::int) / count(distinct o_custkey)")], "orders"))
def kpi_healthcare(spark, folder):
    raw = table(spark, folder, "orders").selectExpr(
        "o_custkey as patient_id", "o_orderkey % 11 as length_of_stay",
        "int(o_orderstatus = 'F') as readmitted")
    return _rounded(B.kpis(raw, "healthcare"), 4, ["value"])


@query("kpi_retail", _kpi_sql([
    ("Total Sales", "sum(o_totalprice)"), ("Average Basket Size", "avg(o_orderkey % 9)"),
    ("Customer Count", "count(distinct o_custkey)")], "orders"))
def kpi_retail(spark, folder):
    raw = table(spark, folder, "orders").selectExpr(
        "o_totalprice as amount", "o_orderkey % 9 as basket_size", "o_custkey as customer_id")
    return _rounded(B.kpis(raw, "retail"), 4, ["value"])


@query("kpi_logistics", _kpi_sql([
    ("Total Shipments", "count(distinct l_orderkey)"), ("Average Delivery Time", "avg(l_quantity)"),
    ("On-Time Delivery Rate", "sum((l_returnflag <> 'R')::int) / count(distinct l_orderkey)")], "lineitem"))
def kpi_logistics(spark, folder):
    raw = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as shipment_id", "l_quantity as delivery_time",
        "int(l_returnflag <> 'R') as on_time_flag")
    return _rounded(B.kpis(raw, "logistics"), 4, ["value"])


@query("kpi_custom", _kpi_sql([
    ("Order Value", "sum(o_totalprice)"), ("Largest Order", "max(o_totalprice)")], "orders"))
def kpi_custom(spark, folder):
    return _rounded(B.kpis(table(spark, folder, "orders"), "none", {
        "Order Value": (["o_totalprice"], "sum"),
        "Largest Order": (["o_totalprice"], lambda found: F.max(found[0]))}), 4, ["value"])


_SKEWS = ("value", "user_id")


@query("insight_rules", "with s as (" + union_all(
    f"select '{c}' as c, avg({c}) m, stddev_samp({c}) sd, skewness({c}) sk from events" for c in _SKEWS)
    + f"""), d as ({_pearson_sql(('event_id', 'user_id', 'value'), 'events')}),
f as (select 'risk' as kind, c as subject, 'High variance detected in ''' || c || '''.' as message from s where sd > 2 * abs(m)
union all select 'risk', c, 'Significant right skew in ''' || c || '''.' from s where sk > 1
union all select 'risk', c, 'Significant left skew in ''' || c || '''.' from s where sk < -1
union all select case when abs(r) > 0.9 then 'risk' else 'opportunity' end, c1 || '/' || c2,
  'dependency' from d where abs(r) > 0.7)
select * from f union all select 'risk', '', 'No significant risks detected based on available data.'
  where not exists (select 1 from f where kind = 'risk')
union all select 'opportunity', '', 'No clear opportunities identified; further domain analysis recommended.'
  where not exists (select 1 from f where kind = 'opportunity')""")
def insight_rules(spark, folder):
    events = table(spark, folder, "events")
    ranked = C.rank_dependencies(events, ["event_id", "user_id", "value"], [], ["pearson"])
    return B.insights(P.numeric_profile(events, list(_SKEWS)), ranked)


@query("insight_summary", """
with k as (select unnest([{'k': 'Total Spend', 'v': sum(o_totalprice)}, {'k': 'Mean Order', 'v': avg(o_totalprice)},
  {'k': 'Customers', 'v': count(distinct o_custkey)}]) as e from orders)
select 'summary' as kind, '' as subject, 'Key KPIs identified:' as message
union all select 'summary', e.k, '- ' || e.k || ': ' || format('{:,.2f}', e.v::double) from k
union all select 'risk', '', 'No significant risks detected based on available data.'
union all select 'opportunity', '', 'No clear opportunities identified; further domain analysis recommended.'""")
def insight_summary(spark, folder):
    orders = table(spark, folder, "orders")
    measured = B.kpis(orders, "none", {"Total Spend": (("o_totalprice",), "sum"), "Mean Order": (("o_totalprice",), "mean"),
                                       "Customers": (("o_custkey",), "nunique")})
    return B.insights(P.numeric_profile(orders, ["o_orderkey"]), None, measured)


# -- personal data ---------------------------------------------------------------------------
def _quote(s):
    return s.replace("'", "''")


def _span_sql(source="documents", key="doc_id", col="text"):
    """All matches with offsets: (key, src, ord, pii_type, m, start, end)."""
    parts = []
    for i, (kind, pattern) in enumerate(X.PATTERNS.items()):
        parts.append(f"""select {key}, {i} as ord, '{kind}' as pii_type, m[i] as m,
          coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s
          from (select {key}, m, p, unnest(range(1, len(m) + 1)) as i from
            (select {key}, regexp_extract_all({col}, '{_quote(pattern)}') as m,
              string_split_regex({col}, '{_quote(pattern)}') as p from {source}))""")
    return "(" + union_all(parts) + ")"


@query("pii_detect", f"""
select doc_id, 'text' as "column", pii_type, m as "match", s::int as "start", (s + length(m))::int as "end"
from {_span_sql()}""")
def pii_detect(spark, folder):
    return X.detect(table(spark, folder, "documents"), ["doc_id"], ["text"])


@query("pii_counts", union_all(
    f"""select '{k}' as pii_type, coalesce(sum(len(regexp_extract_all(text, '{_quote(p)}'))), 0)::bigint as n
    from documents having n > 0""" for k, p in X.PATTERNS.items()))
def pii_counts(spark, folder):
    found = X.detect(table(spark, folder, "documents"), ["doc_id"], ["text"])
    return found.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"))


def _mask_sql(replacement, extra="", where=""):
    """Fold the ordered matches over the text; each list item is match, chr(1), replacement."""
    return f"""with sp as (select doc_id, list(m || chr(1) || {replacement} order by s, ord) as l
      from {_span_sql()} group by 1)
    select d.doc_id{extra}, case when l is null then text else list_reduce(list_prepend(text, l), lambda a, x:
      replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) end as masked
    from documents d left join sp using (doc_id){where}"""


_TOKEN_CASE = "case pii_type " + " ".join(f"when '{k}' then '{v}'" for k, v in X.TOKENS.items()) + " end"


for _strategy, _value in (("redact", "'[REDACTED]'"), ("token", _TOKEN_CASE), ("hash", "sha256(m)")):
    @query(f"pii_mask_{_strategy}", _mask_sql(_value))
    def _mask(spark, folder, strategy=_strategy):
        return X.mask(table(spark, folder, "documents"), ["text"], strategy=strategy).select(
            "doc_id", F.col("text").alias("masked"))


@query("pii_audit", f"""
select doc_id, 'text' as "column", md5(text) as original, md5(masked) as masked, pii_type, m as "match"
from ({_mask_sql("'[REDACTED]'", ', d.text')}) join {_span_sql()} using (doc_id)""")
def pii_audit(spark, folder):
    out = X.audit(table(spark, folder, "documents"), ["doc_id"], ["text"])
    return out.select("doc_id", "column", F.md5(F.col("original_value").cast("binary")).alias("original"),
                      F.md5(F.col("masked_value").cast("binary")).alias("masked"), "pii_type", "match")


@query("cleaning_mask_pii", f"""
select conv_id, turn, case when role is not null then '***MASKED***' end as user_name,
  regexp_replace(regexp_replace(regexp_replace(text, '{_quote(X.STEP_EMAIL)}', '***MASKED***', 'g'),
  '{_quote(X.STEP_PHONE)}', '***MASKED***', 'g'), '{_quote(X.STEP_SSN)}', '***MASKED***', 'g') as text
from conversations""")
def cleaning_mask_pii(spark, folder):
    return X.mask_by_name(table(spark, folder, "conversations").withColumnRenamed("role", "user_name"))


@query("mask_columns", """
select c_custkey, '***MASKED***' as c_name, c_mktsegment from customer""")
def mask_columns(spark, folder):
    return X.mask_columns(table(spark, folder, "customer"), ["c_name"]).select(
        "c_custkey", "c_name", "c_mktsegment")


@query("cleaning_run", """
with raw as (select c_custkey as k, c_name as n, case when c_custkey % 7 = 0 then null else c_acctbal end as a,
  case when c_custkey % 9 = 0 then null else c_mktsegment end as s from customer),
i as (select k, n, coalesce(a, (select avg(a) from raw)) as a, coalesce(s, (select s from raw
  where s is not null group by 1 order by count(*) desc, 1 limit 1)) as s from raw),
q as (select quantile_cont(a, 0.25) a1, quantile_cont(a, 0.75) a3 from i)
select k as cust_id, '***MASKED***' as cust_name, round(a, 4) as acct_bal, s as mkt_segment,
  false as cust_id_anomaly, (a < a1 - 1.5 * (a3 - a1) or a > a3 + 1.5 * (a3 - a1)) as acct_bal_anomaly
from i, q""")
def cleaning_run(spark, folder):
    customer = table(spark, folder, "customer")
    raw = customer.unionAll(customer.filter("c_custkey % 3 = 0")).select(
        F.col("c_custkey").alias("CustID"), F.col("c_name").alias("CustName"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("AcctBal"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("MktSegment"))
    steps = CleaningSteps(["deduplicate", "impute_missing", "detect_anomalies", "mask_pii",
                           "normalize_schema"])
    return steps.run(raw).withColumn("acct_bal", F.round("acct_bal", 4))
