"""Queries on columns, types, validation, joins, SQL, top-k, paging and set operations."""

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.scalars import get_safe
from ..operators import keys as Y
from ..operators import schema as S
from ..operators import topk as K
from ..operators import validate as V
from ..operators.joins import attach_row
from .profiling import EVENTS_GAPS, events_gaps, union_all
from .registry import query, table
from .sqlsurface import run_sql


@query("select_columns", "select o_orderkey, o_totalprice from orders")
def select_columns(spark, folder):
    return S.select_columns(table(spark, folder, "orders"), "o_orderkey, o_totalprice")


LABEL = "p_type || 'Id ' || p_brand || '-' || p_name"


def _labels(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.concat(
        "p_type", F.lit("Id "), "p_brand", F.lit("-"), "p_name").alias("label"))


@query("snake_case_values", f"""
select p_partkey, lower(regexp_replace(regexp_replace(substr(s, 1, 1) ||
  regexp_replace(substr(s, 2), '([A-Z])', '_\\1', 'g'), '[- ]', '_', 'g'), '__+', '_', 'g')) as name
from (select p_partkey, {LABEL} as s from part)""")
def snake_case_values(spark, folder):
    return _labels(spark, folder).select(
        "p_partkey", S.snake_case_column(F.col("label")).alias("name"))


@query("snake_case_acronym", f"""
select p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(s,
  '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[ -]', '_', 'g')) as name
from (select p_partkey, {LABEL} as s from part)""")
def snake_case_acronym(spark, folder):
    return _labels(spark, folder).select(
        "p_partkey", S.snake_case_acronym_column(F.col("label")).alias("name"))


@query("normalize_columns", """
select c_custkey as cust_key, c_name as customer_name, c_acctbal as customer_name_1,
  c_nationkey as nation_key__, c_mktsegment as mkt_segment from customer""")
def normalize_columns(spark, folder):
    raw = table(spark, folder, "customer").toDF(
        "CustKey", "Customer-Name", "NationKey#%", "customer name", "MktSegment")
    return S.normalize_columns(raw)


@query("rename_columns", """
select c_custkey as user_id, c_name as full_name, c_nationkey, c_acctbal, c_mktsegment
from customer""")
def rename_columns(spark, folder):
    raw = table(spark, folder, "customer").toDF(
        "userId", "fullName", "c_nationkey", "c_acctbal", "c_mktsegment")
    return S.rename_columns(raw)


@query("standardize_types", """
select o_orderkey, round(case when o_orderkey % 10 = 0 then null else o_totalprice end, 2) as price,
  o_orderdate as day, 'x' || o_custkey as customer from orders""")
def standardize_types(spark, folder):
    raw = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(
            F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("customer"))
    return S.standardize_types(raw, ["day"])


@query("clean_schema", """
select o_orderkey as order_key, round(o_totalprice, 2) as total_price, o_orderdate as order_date,
  o_orderstatus as order_status from orders""")
def clean_schema(spark, folder):
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("OrderKey"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Total Price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order-Date"),
        F.col("o_orderstatus").alias("OrderStatus"))
    return S.clean_schema(raw, ["order_date"])


@query("schema_issues", """
select * from (values ('o_totalprice', 'type mismatch', 'bigint', 'double'),
  ('o_clerk', 'missing column', 'string', null)) t("column", issue, expected, actual)
where (select count(*) from orders) > 0""")
def schema_issues(spark, folder):
    return S.schema_issues(table(spark, folder, "orders"), {
        "o_orderkey": "bigint", "o_totalprice": "bigint", "o_clerk": "string"})


@query("infer_schema", union_all(
    f"""select 'events' as table_name, {i} as position, '{c}' as "column", '{t}' as sql_type,
    count_if({c} is null) > 0 as nullable,
    count({c}) = count(*) and count(distinct {c}) >= 0.98 * count(*) as primary_key
    from {EVENTS_GAPS}""" for i, (c, t) in enumerate((
        ("event_id", "INTEGER"), ("ts", "TIMESTAMP"), ("user_id", "INTEGER"),
        ("event_type", "TEXT"), ("value", "FLOAT"), ("props", "TEXT")))))
def infer_schema(spark, folder):
    return S.infer_schema(events_gaps(spark, folder), "events")


@query("pk_candidates", "select * from (" + union_all(
    f"""select '{c}' as "column", count(*)::bigint as n_rows, count(distinct {c})::bigint as n_distinct
    from customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    + ") where n_distinct >= 0.98 * n_rows")
def pk_candidates(spark, folder):
    return S.detect_primary_keys(table(spark, folder, "customer"))


@query("drop_null_label_fill_mean", """
with d as (select event_id, case when event_id % 3 = 0 then null else value end as label,
  case when event_id % 7 = 0 then null else (user_id % 50)::double end as x from events)
select event_id, label, round(coalesce(x, (select avg(x) from d where label is not null)), 4) as x
from d where label is not null""")
def drop_null_label_fill_mean(spark, folder):
    raw = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("label"),
        F.when(F.col("event_id") % 7 != 0, (F.col("user_id") % 50).cast("double")).alias("x"))
    return S.drop_null_labels_fill_means(raw, "label", ["x"])[0].withColumn("x", F.round("x", 4))


RULES = {"columns": {
    "event_id": {"unique": True},
    "user_id": {"unique": True},
    "value": {"not_null": True, "min": 0.5, "max": 40.0},
    "event_type": {"pattern": "[cv][a-z]+"},
    "props": {"not_null": True, "warn_if": "length(props) < 10"},
    "country": {"not_null": True},
}}
_RANGE = f"""select event_id, 'value' as "column", value, case when value < 0.5 then
  'less than min 0.5' else 'greater than max 40.0' end as message
  from {EVENTS_GAPS} where value < 0.5 or value > 40.0"""


@query("validate_rules", f"""
select 'country' as "column", 'exists' as rule, 1::bigint as n
union all select 'user_id', 'unique', 1
union all select 'value', 'not_null', 1 union all select 'props', 'not_null', 1
union all select 'value', 'range', count(*) from ({_RANGE})
union all select 'event_type', 'pattern', count(*) from events
  where not regexp_full_match(event_type, '[cv][a-z]+')
union all select 'props', 'warn_if', count(*) from {EVENTS_GAPS}
  where props is null or length(props) >= 10""")
def validate_rules(spark, folder):
    found = V.validate(events_gaps(spark, folder), RULES, ["event_id"])
    return found.groupBy("column", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("validate_not_null", f"""
select 'value' as "column", count_if(value is null)::varchar || ' null values' as message
from {EVENTS_GAPS} union all
select 'props', count_if(props is null)::varchar || ' null values' from {EVENTS_GAPS}""")
def validate_not_null(spark, folder):
    rules = {"columns": {c: {"not_null": True} for c in ("value", "props", "ts")}}
    return V.column_violations(events_gaps(spark, folder), rules).select("column", "message")


@query("validate_unique", f"""
select 'value' as "column", (count(*) - count(distinct value)
  - max(case when value is null then 1 else 0 end))::varchar || ' duplicates' as message
from {EVENTS_GAPS}""")
def validate_unique(spark, folder):
    rules = {"columns": {"value": {"unique": True}, "event_id": {"unique": True}}}
    return V.column_violations(events_gaps(spark, folder), rules).select("column", "message")


@query("validate_range", f"""
select event_id::varchar as row_id, "column", message, value from ({_RANGE})""")
def validate_range(spark, folder):
    rules = {"columns": {"value": RULES["columns"]["value"]}}
    found = V.row_violations(events_gaps(spark, folder), rules, ["event_id"])
    return found.select("row_id", "column", "message", F.col("value").cast("double").alias("value"))


@query("validate_pattern", """
select event_id::varchar as row_id, event_type as value from events
where not regexp_full_match(event_type, '[cv][a-z]+')""")
def validate_pattern(spark, folder):
    rules = {"columns": {"event_type": RULES["columns"]["event_type"]}}
    return V.row_violations(table(spark, folder, "events"), rules, ["event_id"]).select(
        "row_id", "value")


@query("validate_warn", f"""
select event_id::varchar as row_id, 'warning' as severity, props as value from {EVENTS_GAPS}
where props is null or length(props) >= 10""")
def validate_warn(spark, folder):
    rules = {"columns": {"props": {"warn_if": "length(props) < 10"}}}
    return V.row_violations(events_gaps(spark, folder), rules, ["event_id"]).select(
        "row_id", "severity", "value")


@query("validate_report", f"""
select 'event_id' as "column", 'unique' as rules_checked, 0::bigint as n_errors, 0::bigint as n_warnings, true as valid
union all select 'user_id', 'unique', 1, 0, false
union all select 'value', 'max,min,not_null', (select count(*) from ({_RANGE})) + 1, 0, false
union all select 'event_type', 'pattern', (select count(*) from events
  where not regexp_full_match(event_type, '[cv][a-z]+')), 0, false
union all select 'props', 'not_null,warn_if', 1, (select count(*) from {EVENTS_GAPS}
  where props is null or length(props) >= 10), false
union all select 'country', 'not_null', 1, 0, false""")
def validate_report(spark, folder):
    return V.report(events_gaps(spark, folder), RULES, ["event_id"])


@query("fk_violations", """
select l_partkey, count(*)::bigint as n_rows from lineitem
where l_partkey not in (select p_partkey from part where p_size <= 40) group by 1""")
def fk_violations(spark, folder):
    parent = table(spark, folder, "part").filter("p_size <= 40")
    return V.fk_violations(table(spark, folder, "lineitem"), ["l_partkey"], parent, ["p_partkey"])


@query("unique_violations", """
select l_orderkey, l_linenumber, count(*)::bigint as n_rows from lineitem
group by 1, 2 having count(*) > 1""")
def unique_violations(spark, folder):
    return V.unique_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


JOIN_SQL = """
select n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_totalprice > {floor} group by n_name"""


@query("sql_join_agg", JOIN_SQL.format(floor=100000).replace("count(*)", "count(*)::bigint"))
def sql_join_agg(spark, folder):
    names = ("orders", "customer", "nation")
    return run_sql(spark, JOIN_SQL.format(floor=":floor"),
                   {n: table(spark, folder, n) for n in names}, {"floor": 100000})


@query("sql_param_query", """
select o_orderpriority, count(*)::bigint as n from orders where o_orderstatus = 'F'
and o_totalprice between 1000 and 200000 group by 1""")
def sql_param_query(spark, folder):
    return run_sql(spark, """select o_orderpriority, count(*) as n from orders
        where o_orderstatus = :status and o_totalprice between :low and :high group by 1""",
        {"orders": table(spark, folder, "orders")},
        {"status": "F", "low": 1000, "high": 200000})


@query("sql_group_avg", """
select c_mktsegment, round(avg(c_acctbal), 4) as avg_balance from customer group by 1""")
def sql_group_avg(spark, folder):
    return run_sql(spark, """select c_mktsegment, round(avg(c_acctbal), 4) as avg_balance
        from customer group by 1""", {"customer": table(spark, folder, "customer")})


@query("sql_filter", "select o_orderkey, o_totalprice from orders where o_totalprice > 400000")
def sql_filter(spark, folder):
    return run_sql(spark, "select o_orderkey, o_totalprice from orders where o_totalprice > :amount",
                   {"orders": table(spark, folder, "orders")}, {"amount": 400000})


@query("topk_categories", """
select p_partkey, p_brand from part where p_brand in
  (select p_brand from part group by 1 order by count(*) desc, 1 limit 5)""")
def topk_categories(spark, folder):
    kept = K.keep_top_categories(table(spark, folder, "part"), "p_brand", 5)
    return kept.select("p_partkey", "p_brand")


@query("topk_other", """
with c as (select p_brand, count(*) n, sum(p_retailprice) t from part group by 1),
k as (select p_brand from c order by n desc, p_brand limit 5)
select coalesce(k.p_brand, 'Other') as category, sum(n)::bigint as n, round(sum(t), 2) as total
from c left join k using (p_brand) group by 1""")
def topk_other(spark, folder):
    return K.top_with_other(table(spark, folder, "part"), "p_brand", "p_retailprice", 5).withColumn(
        "total", F.round("total", 2))


@query("page_rows", """
select o_orderkey, o_totalprice, (select count(*) from orders)::bigint as total_rows
from orders order by o_orderkey limit 100 offset 200""")
def page_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    total = K.page_info(orders).select("total_rows")
    return attach_row(K.page(orders, ["o_orderkey"], 3, 100), total)


@query("preview_head", "select * from orders order by o_orderkey limit 10")
def preview_head(spark, folder):
    return K.preview(table(spark, folder, "orders"), ["o_orderkey"])


@query("sample_points")
def sample_points(spark, folder):
    return K.sample_points(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("union_by_name", """
select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment
from customer union all select s_suppkey, s_name, s_acctbal, null from supplier""")
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").selectExpr(
        "c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment")
    suppliers = table(spark, folder, "supplier").selectExpr(
        "s_suppkey as key", "s_acctbal as balance", "s_name as name")
    return K.union_by_name([customers, suppliers])


@query("json_get_safe", """
select event_id, coalesce(props ->> '$.k', 'none') as k,
  coalesce(props ->> '$.a.b', 'none') as nested from events""")
def json_get_safe(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", get_safe(F.col("props"), "k", "none").alias("k"),
        get_safe(F.col("props"), ["a", "b"], "none").alias("nested"))


_KEY_COLUMNS = ("conv_id", "turn", "role")
_KEY_SETS = [c for n in (1, 2, 3) for c in combinations(_KEY_COLUMNS, n)]


@query("minimal_keys", "with k as (" + union_all(
    f"select [{', '.join(repr(c) for c in s)}] as s, count(*)::bigint as n_rows, count(distinct ({', '.join(s)})) = count(*) as is_key "
    f"from conversations" for s in _KEY_SETS) + """)
select array_to_string(s, ',') as columns, n_rows from k where is_key and not exists (
  select 1 from k p where p.is_key and len(p.s) < len(k.s) and list_has_all(k.s, p.s))""")
def minimal_keys(spark, folder):
    found = Y.minimal_keys(table(spark, folder, "conversations"), _KEY_COLUMNS)
    return found.select(F.array_join("columns", ",").alias("columns"), "n_rows")
