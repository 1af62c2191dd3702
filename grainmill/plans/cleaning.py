"""Queries on windows, duplicates, imputation and scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import dedup as D
from ..operators import impute as I
from ..operators import windows as W
from .profiling import EVENTS_GAPS, events_gaps, union_all
from .registry import query, table

EVENT_ORDER = ["ts", "event_id"]
BY_USER = "over (partition by user_id order by ts, event_id"


@query("lag_features", f"""
select event_id, lag(value, 1) {BY_USER}) as value_lag_1, lag(value, 3) {BY_USER}) as value_lag_3
from events""")
def lag_features(spark, folder):
    out = W.lag_features(table(spark, folder, "events"), ["value"], [1, 3], ["user_id"], EVENT_ORDER)
    return out.select("event_id", "value_lag_1", "value_lag_3")


def _roll(stat, fn, w):
    frame = f"{BY_USER} rows between {w - 1} preceding and current row)"
    return (f"round(case when count(value) {frame} = {w} then {fn}(value) {frame} end, 4) + 0.0 "
            f"as value_roll_{w}_{stat}")


_ROLLS = [(s, f, w) for w in (3, 7) for s, f in
          (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]


@query("rolling_stats", f"""
select event_id, {', '.join(_roll(*r) for r in _ROLLS)} from {EVENTS_GAPS}""")
def rolling_stats(spark, folder):
    out = W.rolling_features(events_gaps(spark, folder), ["value"], [3, 7], ["user_id"],
                             EVENT_ORDER, ["mean", "std", "min", "max"])
    return out.select("event_id", *[(F.round(f"value_roll_{w}_{s}", 4) + F.lit(0.0)).alias(
        f"value_roll_{w}_{s}") for s, _, w in _ROLLS])


@query("impute_ffill", f"""
select event_id, last_value(value ignore nulls) {BY_USER}
  rows between unbounded preceding and current row) as value from {EVENTS_GAPS}""")
def impute_ffill(spark, folder):
    imputer = I.Imputer("ffill", order_by=EVENT_ORDER, keys=["user_id"])
    return imputer.fit_transform(events_gaps(spark, folder), ["value"]).select("event_id", "value")


@query("impute_bfill", f"""
select event_id, first_value(value ignore nulls) {BY_USER}
  rows between current row and unbounded following) as value from {EVENTS_GAPS}""")
def impute_bfill(spark, folder):
    imputer = I.Imputer("bfill", order_by=EVENT_ORDER, keys=["user_id"])
    return imputer.fit_transform(events_gaps(spark, folder), ["value"]).select("event_id", "value")


REPEATED = """(select event_id, user_id, event_type, value from events
  union all select event_id, user_id, event_type, value from events where event_id % 4 = 0)"""


def _repeated(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return events.unionAll(events.filter("event_id % 4 = 0"))


@query("duplicate_flags", """
select event_id,
  row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as dup_first,
  row_number() over (partition by user_id, event_type order by ts desc, event_id desc) > 1 as dup_last,
  count(*) over (partition by user_id, event_type) > 1 as dup_any from events""")
def duplicate_flags(spark, folder):
    out = table(spark, folder, "events")
    for keep, name in (("first", "dup_first"), ("last", "dup_last"), ("none", "dup_any")):
        out = D.duplicate_flags(out, ["user_id", "event_type"], EVENT_ORDER, keep, name)
    return out.select("event_id", "dup_first", "dup_last", "dup_any")


@query("dedup_all", f"select distinct event_id, user_id, event_type, value from {REPEATED}")
def dedup_all(spark, folder):
    return D.remove_duplicates(_repeated(spark, folder))


for _keep, _order in (("first", "ts, event_id"), ("last", "ts desc, event_id desc")):
    @query(f"dedup_subset_{_keep}", f"""
    select event_id, user_id, event_type, value, ts from (select *, row_number() over
      (partition by user_id, event_type order by {_order}) as r from events) where r = 1""")
    def _dedup_subset(spark, folder, keep=_keep):
        events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "ts")
        return D.remove_duplicates(events, ["user_id", "event_type"], EVENT_ORDER, keep)


@query("dedup_subset_none", """
select event_id, user_id, value from (select *, count(*) over (partition by user_id, value) as c
from events) where c = 1""")
def dedup_subset_none(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return D.remove_duplicates(events, ["user_id", "value"], keep="none")


@query("dedup_report", f"""
select count(*)::bigint as initial_rows, count(distinct event_id)::bigint as final_rows,
  (count(*) - count(distinct event_id))::bigint as duplicates_found,
  (count(*) - count(distinct event_id))::bigint as rows_removed, 'first' as keep from {REPEATED}""")
def dedup_report(spark, folder):
    return D.dedup_report(_repeated(spark, folder))


@query("tail_holdout", """
select event_id, case when row_number() over (partition by user_id order by ts desc, event_id desc) <= 5
  then 'validation' else 'train' end as split from events""")
def tail_holdout(spark, folder):
    return W.tail_holdout(table(spark, folder, "events"), 5, ["user_id"], EVENT_ORDER).select(
        "event_id", "split")


@query("timeseries_folds", """
with d as (select event_id, row_number() over (partition by event_type order by ts, event_id) r,
  count(*) over (partition by event_type) n from events)
select event_id, (case when r <= n - 5 * (n // 6) then 0
  else (r - (n - 5 * (n // 6)) - 1) // (n // 6) + 1 end)::int as fold from d""")
def timeseries_folds(spark, folder):
    return W.timeseries_folds(table(spark, folder, "events"), 5, ["event_type"], EVENT_ORDER).select(
        "event_id", "fold")


@query("sequence_windows", """
select event_id, value, s[1] as first_value, s[5] as last_value, len(s)::int as steps,
  list_sum(s)::decimal(18,2)::double as total from (select event_id, value, list(value) over
  (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding) s from events)
where len(s) = 5""")
def sequence_windows(spark, folder):
    out = W.sequence_windows(table(spark, folder, "events"), "value", 5, ["user_id"], EVENT_ORDER,
                             exog=["event_type"])
    total = F.aggregate("sequence", F.lit(0.0), lambda a, s: a + s["value"])
    return out.select("event_id", "value", F.col("sequence")[0]["value"].alias("first_value"),
                      F.col("sequence")[4]["value"].alias("last_value"),
                      F.size("sequence").alias("steps"), F.round(total, 2).alias("total"))


@query("trend_direction", """
with e as (select user_id, arg_min(value, (ts, event_id)) as first_value,
  arg_max(value, (ts, event_id)) as last_value from events group by 1)
select *, case when last_value > first_value then 'up' when last_value < first_value then 'down'
  else 'flat' end as direction from e""")
def trend_direction(spark, folder):
    return W.trend_direction(table(spark, folder, "events"), "value", ["user_id"], EVENT_ORDER)


@query("seasonal_difference", """
select event_id, round(value - lag(value, 12) over (partition by user_id order by ts, event_id), 4)
  + 0.0 as seasonal_diff from events""")
def seasonal_difference(spark, folder):
    out = W.seasonal_difference(table(spark, folder, "events"), "value", 12, ["user_id"], EVENT_ORDER)
    return out.select("event_id", (F.round("seasonal_diff", 4) + F.lit(0.0)).alias("seasonal_diff"))


# -- imputation ---------------------------------------------------------------------------
_FILL = {
    "mean": "avg(value)",
    "median": "median(value)",
}
for _strategy, _expr in _FILL.items():
    @query(f"impute_{_strategy}", f"""
    select event_id, round(coalesce(value, (select {_expr} from {EVENTS_GAPS})), 4) as value
    from {EVENTS_GAPS}""")
    def _impute(spark, folder, strategy=_strategy):
        out = I.Imputer(strategy).fit_transform(events_gaps(spark, folder), ["value"])
        return out.select("event_id", F.round("value", 4).alias("value"))


@query("impute_mode", f"""
select event_id, coalesce(value, (select value from {EVENTS_GAPS} where value is not null
  group by 1 order by count(*) desc, 1 limit 1)) as value,
  coalesce(props, (select props from {EVENTS_GAPS} where props is not null
  group by 1 order by count(*) desc, 1 limit 1)) as props from {EVENTS_GAPS}""")
def impute_mode(spark, folder):
    out = I.Imputer("mode").fit_transform(events_gaps(spark, folder), ["value", "props"])
    return out.select("event_id", "value", "props")


@query("impute_plan", """
select * from (values ('o_orderkey', 0.0, 'none'), ('a', 0.5, 'median'), ('b', 0.25, 'knn'),
  ('c', 0.0625, 'mean'), ('d', 0.5, 'mode'), ('e', 0.125, 'ffill'), ('t', 0.5, 'mode'))
  t("column", nominal, strategy) where (select count(*) from orders) > 0""".replace(
    "select *", 'select "column", nominal::double as nominal, strategy'))
def impute_plan(spark, folder):
    def hole(c, every):
        return F.when(F.col("o_orderkey") % every != 0, F.col(c))

    raw = table(spark, folder, "orders").select(
        "o_orderkey", hole("o_totalprice", 2).alias("a"), hole("o_totalprice", 4).alias("b"),
        hole("o_totalprice", 16).alias("c"), hole("o_orderstatus", 2).alias("d"),
        hole("o_orderpriority", 8).alias("e"), hole("o_orderdate", 2).alias("t"))
    return I.imputation_plan(raw).select(
        "column", (F.round(F.col("ratio") * 16) / 16).alias("nominal"), "strategy")


@query("impute_constant", f"""
select event_id, coalesce(value, -1.0) as value from {EVENTS_GAPS}""")
def impute_constant(spark, folder):
    return I.impute_constant(events_gaps(spark, folder), -1.0, ["value"]).select("event_id", "value")


@query("cleaning_impute", f"""
select event_id, round(coalesce(value, (select avg(value) from {EVENTS_GAPS})), 4) as value,
  coalesce(props, (select props from {EVENTS_GAPS} where props is not null
  group by 1 order by count(*) desc, 1 limit 1)) as props, 'MISSING' as note from {EVENTS_GAPS}""")
def cleaning_impute(spark, folder):
    raw = events_gaps(spark, folder).select(
        "event_id", "value", "props", F.lit(None).cast("string").alias("note"))
    return I.impute_default(raw).withColumn("value", F.round("value", 4))


# -- scalar functions ---------------------------------------------------------------------
_SPARK_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss",
                  "dd-MMM-yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yy",
                  "yyyy.MM.dd", "dd-MM-yyyy")
_DUCK_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%d-%b-%Y",
                 "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%m/%d/%y", "%Y.%m.%d", "%d-%m-%Y")


@query("parse_datetime", "with t as (select l_orderkey, l_linenumber, l_partkey, l_shipdate, case "
       "(l_orderkey + l_linenumber) % 12 "
       + " ".join(f"when {i} then strftime(l_shipdate, '{f}')" for i, f in enumerate(_DUCK_FORMATS))
       + " else 'not a date' end as s from lineitem) select l_orderkey, l_linenumber, l_partkey, s, "
       + "coalesce(" + ", ".join(
           f"case when regexp_matches(s, '{4 if '%Y' in f else 2}') then try_strptime(s, '{f}') end"
           .replace("'4'", "'\\d{4}'").replace("'2'", "'\\d'") for f in _DUCK_FORMATS) + ") as parsed from t")
def parse_datetime(spark, folder):
    turn = (F.col("l_orderkey") + F.col("l_linenumber")) % 12
    text = F.lit("not a date")
    for i, f in enumerate(_SPARK_FORMATS):
        text = F.when(turn == i, F.date_format("l_shipdate", f)).otherwise(text)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.alias("s"),
        X.parse_datetime(text).alias("parsed"))


@query("normalize_string", """
select doc_id, lower(nfc_normalize(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as clean
from documents""")
def normalize_string(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.normalize_string(F.col("text")).alias("clean"))


@query("trim_whitespace", """
select doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as clean
from documents""")
def trim_whitespace(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.trim_whitespace(F.col("text")).alias("clean"))


@query("sanitize_text", """
select page_id, replace(regexp_replace(html, '(--|;|/\\*|\\*/|xp_|\\bDROP\\b|\\bTABLE\\b)', '', 'gi'),
  '''', '''''') as clean from pages""")
def sanitize_text(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.prevent_injection(F.col("html")).alias("clean"))


@query("sanitize_map", """
select c_custkey, lower(trim('  ' || c_name || ' ')) as name,
  lower(trim(c_mktsegment || '  ')) as segment from customer""")
def sanitize_map(spark, folder):
    raw = F.create_map(F.lit("name"), F.concat(F.lit("  "), "c_name", F.lit(" ")),
                       F.lit("segment"), F.concat("c_mktsegment", F.lit("  ")))
    clean = X.sanitize_map(raw, lambda v: F.lower(F.trim(v)))
    return table(spark, folder, "customer").select("c_custkey", clean.alias("m")).select(
        "c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"))


_MIXED = """(select o_orderkey, case o_orderkey % 4 when 0 then o_custkey::varchar
  when 1 then o_custkey::varchar || '.5' when 2 then ' 7 ' else o_orderpriority end as s from orders)"""


def _mixed(spark, folder):
    key = F.col("o_orderkey") % 4
    text = (F.when(key == 0, F.col("o_custkey").cast("string"))
             .when(key == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
             .when(key == 2, F.lit(" 7 ")).otherwise(F.col("o_orderpriority")))
    return table(spark, folder, "orders").select("o_orderkey", text.alias("s"))


@query("safe_casts", f"""
select o_orderkey, case when o_orderkey % 4 in (0, 2) then try_cast(trim(s) as bigint) else 0 end as i,
  coalesce(try_cast(trim(s) as double), 0.0) as d from {_MIXED}""")
def safe_casts(spark, folder):
    return _mixed(spark, folder).select("o_orderkey", X.safe_int(F.col("s")).alias("i"),
                                        X.safe_float(F.col("s")).alias("d"))


@query("to_bool", """
select event_id, lower(trim(s)) in ('true', 'yes', '1', 'y') as b, (user_id % 3) <> 0 as n
from (select event_id, user_id, case event_id % 6 when 0 then ' TRUE ' when 1 then 'Yes'
  when 2 then '1' when 3 then 'y' when 4 then 'no' else event_type end as s from events)""")
def to_bool(spark, folder):
    words = F.array(*[F.lit(w) for w in (" TRUE ", "Yes", "1", "y", "no")])
    turn = (F.col("event_id") % 6).cast("int")
    text = F.when(turn < 5, F.get(words, turn)).otherwise(F.col("event_type"))
    return table(spark, folder, "events").select(
        "event_id", X.to_bool(text).alias("b"),
        X.to_bool(F.col("user_id") % 3, text=False).alias("n"))


@query("map_merge", """
select event_id, json_merge_patch(props::json, json_object('v', value::varchar,
  'k', case when event_id % 2 = 0 then 'even' else props ->> '$.k' end)) ->> '$.k' as k,
  value::varchar as v, 2 as size from events""")
def map_merge(spark, folder):
    left = F.from_json("props", "map<string,string>")
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(
        F.lit("v"), F.col("value").cast("string"), F.lit("k"), F.lit("even"))).otherwise(
        F.create_map(F.lit("v"), F.col("value").cast("string")))
    merged = X.deep_merge_maps(left, right)
    return table(spark, folder, "events").select("event_id", merged.alias("m")).select(
        "event_id", F.col("m")["k"].alias("k"), F.col("m")["v"].alias("v"), F.size("m").alias("size"))


@query("is_empty", """
select event_id, event_id % 3 <> 2 as text_empty, event_id % 4 <> 3 as list_empty from events""")
def is_empty(spark, folder):
    turn = F.col("event_id")
    text = F.when(turn % 3 == 0, F.lit("")).when(turn % 3 == 2, F.col("event_type"))
    items = F.when(turn % 4 == 0, F.array().cast("array<string>")).when(
        turn % 4 == 1, F.lit(None).cast("array<string>")).when(
        turn % 4 == 2, F.filter(F.array("event_type"), lambda x: F.lit(False))).otherwise(
        F.array("event_type"))
    return table(spark, folder, "events").select(
        "event_id", X.is_empty(text).alias("text_empty"),
        X.is_empty(items, collection=True).alias("list_empty"))


@query("chunk_array", """
select vec_id, i::int as chunk, len(embedding[i * 10 + 1 : i * 10 + 10])::int as size,
  round(list_sum(embedding[i * 10 + 1 : i * 10 + 10])::double, 3) + 0.0 as total
from embeddings, range(100) r(i) where i * 10 < len(embedding)""")
def chunk_array(spark, folder):
    chunks = table(spark, folder, "embeddings").select(
        "vec_id", F.posexplode(X.chunk_array(F.col("embedding"), 10)).alias("chunk", "part"))
    total = F.aggregate("part", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return chunks.select("vec_id", "chunk", F.size("part").alias("size"),
                         (F.round(total, 3) + F.lit(0.0)).alias("total"))


@query("mape", """
select l_returnflag, round(avg(abs((l_quantity - p) / l_quantity)) * 100, 4) as mape
from (select l_returnflag, l_quantity, l_extendedprice / 2000 as p from lineitem)
where l_quantity <> 0 group by 1""")
def mape(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.round(X.mape(F.col("l_quantity"), F.col("l_extendedprice") / 2000), 4).alias("mape"))
