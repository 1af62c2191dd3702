"""Queries on time series: orders per day with missing days filled, events per type and hour."""

from pyspark.sql import functions as F

from ..operators import segments as G
from ..operators import stationarity as S
from ..operators import stl as L
from ..operators import timeseries as T
from .registry import query, table

DAILY = """(select d::timestamp as day, coalesce(v, 0) as v from
  (select unnest(generate_series((select min(o_orderdate) from orders)::date,
     (select max(o_orderdate) from orders)::date, interval 1 day)) as d) c
  left join (select o_orderdate, sum(o_totalprice) / 1000 as v from orders group by 1) o
  on o.o_orderdate = c.d)"""


def daily(spark, folder):
    """Thousands of order value per day; days without orders count as zero."""
    orders = table(spark, folder, "orders")
    sums = orders.groupBy(F.col("o_orderdate").alias("day")).agg(
        (F.sum("o_totalprice") / 1000).alias("v"))
    days = T.calendar(sums, "day", "day")
    return days.join(sums, "day", "left").fillna(0.0, ["v"])


HOURLY = """(select event_type, date_trunc('hour', ts) as hour, sum(value) as v from events group by 1, 2)"""


def hourly(spark, folder):
    return table(spark, folder, "events").groupBy(
        "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.sum("value").alias("v"))


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


@query("infer_period", f"""
select 'daily' as series, count(*)::bigint as n, 86400.0::double as gap_seconds, 7 as period from {DAILY}
union all select * from (with g as (select event_type, epoch(hour) - epoch(lag(hour) over
  (partition by event_type order by hour)) as gap from {HOURLY})
select event_type, count(*)::bigint, (select gap from g h where h.event_type = g.event_type and gap is not null
  group by 1 order by count(*) desc, gap limit 1)::double, 24 from g group by 1)""")
def infer_period(spark, folder):
    one = T.infer_period(daily(spark, folder), "day").withColumn("event_type", F.lit("daily"))
    many = T.infer_period(hourly(spark, folder), "hour", ["event_type"])
    return one.unionByName(many).withColumnRenamed("event_type", "series")


_DECOMPOSED = """(with p as (select *, (row_number() over (partition by {k} order by {o}) - 1) % {m} as ph,
  case when count(v) over w = {m} then avg(v) over w end as trend from {src}
  window w as (partition by {k} order by {o} rows between {h} preceding and {h} following)),
s as (select {k} as k, ph, avg(v - trend) as s from p group by 1, 2),
c as (select k, ph, s - avg(s) over (partition by k) as seasonal from s)
select p.*, c.seasonal, v - trend - seasonal as resid from p join c on c.k is not distinct from p.{kk} and c.ph = p.ph)"""
_DAY7 = _DECOMPOSED.format(k="one", kk="one", o="day", m=7, h=3, src=f"(select 1 as one, * from {DAILY})")


@query("decompose_additive", f"""
select day, round(trend, 3) + 0.0 as trend, round(seasonal, 3) + 0.0 as seasonal,
  round(resid, 3) + 0.0 as resid from {_DAY7}""")
def decompose_additive(spark, folder):
    out = T.decompose(daily(spark, folder), "v", 7, [], ["day"])
    return _round(out.drop("v"), 3, "trend", "seasonal", "resid")


@query("decompose_keyed", f"""
with p as (select *, (row_number() over (partition by event_type order by hour) - 1) % 24 as ph,
  case when count(v) over (partition by event_type order by hour rows between 12 preceding and 12 following) = 25
  then (sum(v) over (partition by event_type order by hour rows between 11 preceding and 11 following)
  + (lag(v, 12) over (partition by event_type order by hour) + lead(v, 12) over (partition by event_type order by hour)) / 2) / 24
  end as trend from {HOURLY}),
s as (select event_type, ph, avg(v - trend) as s from p group by 1, 2),
c as (select event_type, ph, s - avg(s) over (partition by event_type) as seasonal from s)
select event_type, hour, round(trend, 7) + 0.0 as trend, round(seasonal, 7) + 0.0 as seasonal,
  round(v - trend - seasonal, 7) + 0.0 as resid from p join c using (event_type, ph)""")
def decompose_keyed(spark, folder):
    out = T.decompose(hourly(spark, folder), "v", 24, ["event_type"], ["hour"])
    return _round(out.drop("v"), 7, "trend", "seasonal", "resid")


@query("residual_anomalies", f"""
with d as (select day, resid from {_DAY7} where resid is not null),
z as (select day, resid, (resid - (select avg(resid) from d)) / (select stddev_pop(resid) from d) as z from d)
select day, round(resid, 3) as resid, round(z, 4) as zscore from z where abs(z) > 2""")
def residual_anomalies(spark, folder):
    out = T.residual_anomalies(daily(spark, folder), "v", 7, [], ["day"], 2.0)
    return _round(_round(out, 3, "resid"), 4, "zscore")


@query("changepoints", f"""
with d as (select event_type, v, row_number() over (partition by event_type order by hour) as p,
  count(*) over (partition by event_type) as n, sum(v) over (partition by event_type) as t from {HOURLY}),
l as (select event_type, p, n, (p - 1)::double as k, t, sum(v) over (partition by event_type order by p
  rows between unbounded preceding and 1 preceding) as s from d),
g as (select event_type, p, k * (n - k) / n * power(s / k - (t - s) / (n - k), 2) as gain from l where k > 0)
select event_type, 1::bigint as segment, arg_max(p, (gain, -p))::bigint as position, round(max(gain), 2) as gain
from g group by 1 having max(gain) > 10""")
def changepoints(spark, folder):
    out = T.changepoints(hourly(spark, folder), "v", ["event_type"], ["hour"], max_depth=1)
    return _round(out, 2, "gain")


@query("changepoints_deep")
def changepoints_deep(spark, folder):
    out = T.changepoints(hourly(spark, folder), "v", ["event_type"], ["hour"], penalty=10000.0, max_depth=4)
    return _round(out, 2, "gain")


def _segments_sql(penalty, least, jump):
    """Recursive SQL over the places of the grid: the best cost of every beginning, tried with every last change."""
    cost = f"""list_transform(range(0, k + 1), lambda i: f[i + 1] + q[t + 1] - q[{jump} * i + 1]
      - power(s[t + 1] - s[{jump} * i + 1], 2) / (t - {jump} * i) + {penalty} + case when t - {jump} * i < {least} then 1e300 else 0 end)"""
    return f"""
with recursive c as (select event_type, hour, sum(v) over w as s, sum(v * v) over w as q from {HOURLY}
  window w as (partition by event_type order by hour)),
l as (select event_type, count(*) as n, list_prepend(0.0, list(s order by hour)) as s, list_prepend(0.0, list(q order by hour)) as q
  from c group by 1),
r as (select event_type, 0::bigint as k, [0.0::double] as f, [0::bigint] as b from l
  union all select event_type, k + 1, list_append(f, list_min(cost)::double), list_append(b, list_position(cost, list_min(cost)) - 1)
  from (select r.*, {cost} as cost from (select r.*, l.s, l.q, least(l.n, (k + 1) * {jump}) as t from r join l using (event_type)
    where k * {jump} < l.n) r)),
ends as (select event_type, arg_max(b, k) as b, max(k) as k from r group by 1),
w as (select event_type, b, k, b[k + 1] as j from ends union all select event_type, b, j, b[j + 1] from w where j > 0)
select event_type, (j * {jump} + 1)::bigint as first, least(n, k * {jump})::bigint as last,
  round((s[least(n, k * {jump}) + 1] - s[j * {jump} + 1]) / (least(n, k * {jump}) - j * {jump}), 4) as level
from w join l using (event_type)"""


@query("changepoints_optimal", _segments_sql(10.0, 2, 5))
def changepoints_optimal(spark, folder):
    out = G.optimal_segments(hourly(spark, folder), "v", ["event_type"], ["hour"])
    return _round(out.drop("error"), 4, "level")


@query("changepoints_every_hour", _segments_sql(200000.0, 1, 1))
def changepoints_every_hour(spark, folder):
    out = G.optimal_segments(hourly(spark, folder), "v", ["event_type"], ["hour"], 200000.0, 1, 1)
    return _round(out.drop("error"), 4, "level")


@query("kpss_stat", f"""
with e as (select event_type, hour, v - avg(v) over (partition by event_type) as e from {HOURLY}),
s as (select event_type, e, sum(e) over (partition by event_type order by hour) as s from e)
select event_type, count(*)::bigint as n, round(sum(s * s) / (count(*) * count(*)) / (sum(e * e) / count(*)), 4) as statistic,
  sum(s * s) / (count(*) * count(*)) / (sum(e * e) / count(*)) < 0.463 as stationary from s group by 1""")
def kpss_stat(spark, folder):
    return _round(T.kpss(hourly(spark, folder), "v", ["event_type"], ["hour"]), 4, "statistic")


@query("adf_stat", f"""
with d as (select event_type, lag(v) over (partition by event_type order by hour) as x,
  v - lag(v) over (partition by event_type order by hour) as d from {HOURLY}),
f as (select event_type, count(*) as n, regr_slope(d, x) as b, regr_sxx(d, x) as sxx,
  regr_syy(d, x) as syy, regr_sxy(d, x) as sxy from d where x is not null group by 1)
select event_type, n::bigint as n, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 3) as statistic,
  b / sqrt((syy - b * sxy) / (n - 2) / sxx) < -2.86 as stationary from f""")
def adf_stat(spark, folder):
    return _round(T.adf(hourly(spark, folder), "v", ["event_type"], ["hour"]), 3, "statistic")


_GRAM = """{name} as (select event_type, list(cells order by i) as m from (select event_type, i, list(c order by j) as cells
  from (select event_type, i, j, sum(x[i] * x[j]) as c from (select event_type, x, unnest(range(1, len(x) + 1)) as i from {rows}),
    unnest(range(1, len(x) + 1)) u(j) group by 1, 2, 3) group by 1, 2) group by 1)"""
_ELIMINATED = """{name} as (select event_type, 0::bigint as k, m from {gram} union all
  select event_type, k + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j:
    case when i = k + 1 then m[i][j] else m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] end)) from {name} where k < len(m) - 1)"""
# Every number of lags is fitted by eliminating one column after another; the best is fitted again to its own rows.
_ADF_BY_AIC = f"""
with recursive y as (select event_type, count(*) as n, least(ceil(12 * power(count(*) / 100.0, 0.25)), count(*) // 2 - 2)::bigint as most,
  list(v order by hour) as y from (select event_type, hour, v - avg(v) over (partition by event_type) as v from {HOURLY}) group by 1),
wide as (select event_type, list_concat([1.0, y[t - 1]], list_transform(range(1, most + 1), lambda j: y[t - j] - y[t - j - 1]), [y[t] - y[t - 1]]) as x
  from (select *, unnest(range(most + 2, n + 1)) as t from y)),
{_GRAM.format(name="gram", rows="wide")}, {_ELIMINATED.format(name="fits", gram="gram")},
best as (select event_type, arg_min(k - 2, ((n - most - 1) * ln(m[len(m)][len(m)]) + 2 * k, k))::bigint as p
  from fits join y using (event_type) where k >= 2 group by 1),
own as (select event_type, list_concat([1.0], list_transform(range(1, p + 1), lambda j: y[t - j] - y[t - j - 1]), [y[t - 1], y[t] - y[t - 1]]) as x
  from (select *, unnest(range(p + 2, n + 1)) as t from y join best using (event_type))),
{_GRAM.format(name="gram2", rows="own")}, {_ELIMINATED.format(name="fit2", gram="gram2")},
last as (select event_type, n, p, n - p - 1 as obs, m[p + 2][p + 2] as a, m[p + 2][p + 3] as b, m[p + 3][p + 3] as c
  from fit2 join best using (event_type) join y using (event_type) where k = p + 1)
select event_type, n::bigint as n, p as n_lags, obs::bigint as n_obs, round(b / a / sqrt((c - b * b / a) / (obs - p - 2) / a), 5) as statistic,
  round(-3.43035 - 6.5393 / obs - 16.786 / power(obs, 2) - 79.433 / power(obs, 3), 6) as crit_1,
  round(-2.86154 - 2.8903 / obs - 4.234 / power(obs, 2) - 40.040 / power(obs, 3), 6) as crit_5,
  round(-2.56677 - 1.5384 / obs - 2.809 / power(obs, 2), 6) as crit_10 from last"""


@query("adf_by_aic", _ADF_BY_AIC)
def adf_by_aic(spark, folder):
    out = S.adf_test(hourly(spark, folder), "v", ["event_type"], ["hour"])
    return _round(_round(out.drop("pvalue", "stationary"), 5, "statistic"), 6, "crit_1", "crit_5", "crit_10")


def solved_sql(rows, before=""):
    """CTEs up to `fit` (event_type, m): the cross products of `rows` (event_type, x), all columns but the last eliminated."""
    return f"""recursive {before}{_GRAM.format(name="gram", rows=rows)}, {_ELIMINATED.format(name="fits", gram="gram")},
fit as (select event_type, arg_max(m, k) as m from fits group by 1)"""


@query("adf_lagged", f"""
with recursive y as (select event_type, count(*) as n, list(v order by hour) as y
  from (select event_type, hour, v - avg(v) over (partition by event_type) as v from {HOURLY}) group by 1),
own as (select event_type, [1.0, y[t - 1] - y[t - 2], y[t - 2] - y[t - 3], y[t - 1], y[t] - y[t - 1]] as x
  from (select *, unnest(range(4, n + 1)) as t from y)),
{_GRAM.format(name="gram", rows="own")}, {_ELIMINATED.format(name="fits", gram="gram")},
last as (select event_type, n - 3 as obs, m[4][4] as a, m[4][5] as b, m[5][5] as c from fits join y using (event_type) where k = 3),
t as (select event_type, obs, b / a / sqrt((c - b * b / a) / (obs - 4) / a) as t from last)
select event_type, obs::bigint as n, round(t, 3) + 0.0 as statistic, t < -2.86 as stationary from t""")
def adf_lagged(spark, folder):
    return _round(T.adf(hourly(spark, folder), "v", ["event_type"], ["hour"], lags=2), 3, "statistic")


_KPSS_AUTO = f"""
with e as (select event_type, count(*) as n, list(v order by hour) as e from
  (select event_type, hour, v - m - coalesce(b, 0) * (t - (c + 1) / 2) as v from
    (select event_type, hour, v, avg(v) over w as m, {{slope}} as b, row_number() over (partition by event_type order by hour) as t,
       count(*) over w as c from {HOURLY} window w as (partition by event_type))) group by 1),
p as (select *, list_transform(range(0, floor(power(n, 2.0 / 9))::bigint + 1), lambda k:
  list_sum(list_transform(range(k + 1, n + 1), lambda i: e[i] * e[i - k]))) as c from e),
s as (select *, c[1] / n + list_sum(c[2:]) / (n / 2) as s0, list_sum(list_transform(range(1, len(c)), lambda k: k * c[k + 1])) / (n / 2) as s1 from p),
l as (select *, least(floor(1.1447 * power(power(s1 / s0, 2), 1.0 / 3) * power(n, 1.0 / 3)), n - 1)::bigint as lags from s),
d as (select event_type, n, lags, (c[1] + 2 * coalesce(list_sum(list_transform(range(1, lags + 1), lambda k: (1 - k / (lags + 1)) *
  list_sum(list_transform(range(k + 1, n + 1), lambda i: e[i] * e[i - k])))), 0)) / n as spread, e from l),
r as (select event_type, sum(s * s) as squares from (select event_type, sum(v) over (partition by event_type order by i) as s
  from (select event_type, unnest(e) as v, generate_subscripts(e, 1) as i from e)) group by 1)
select event_type, n::bigint as n, lags as n_lags, round(squares / power(n, 2) / spread, 5) as statistic, {{limit}}::double as crit_5
from d join r using (event_type)"""
_NUMBERED = f"(select *, row_number() over (partition by event_type order by hour) as t from {HOURLY})"


@query("kpss_auto", _KPSS_AUTO.format(slope="0", limit="0.463"))
def kpss_auto(spark, folder):
    out = S.kpss_test(hourly(spark, folder), "v", ["event_type"], ["hour"])
    return _round(out.select("event_type", "n", "n_lags", "statistic", "crit_5"), 5, "statistic")


@query("kpss_trend", _KPSS_AUTO.format(
    slope=f"(select regr_slope(x.v, x.t) from {_NUMBERED} x where x.event_type = h.event_type)", limit="0.146").replace(
    f"from {HOURLY} window", f"from {HOURLY} h window"))
def kpss_trend(spark, folder):
    out = S.kpss_test(hourly(spark, folder), "v", ["event_type"], ["hour"], "ct")
    return _round(out.select("event_type", "n", "n_lags", "statistic", "crit_5"), 5, "statistic")


def _lines_sql(name, source, span, ends=0):
    """CTE (g, i, v): weighted lines through the nearest rows of `source` (g, i, y, w), carried on by `ends` places."""
    return f"""{name} as materialized (
select g, i, case when sqrt(greatest(sxx / sw - power(sx / sw, 2), 0)) > 0.001 * (k - 1)
    then sy / sw - sx / sw / (sxx / sw - power(sx / sw, 2)) * (sxy / sw - sx / sw * sy / sw) else sy / sw end as v
from (select g, i, k, sum(w) as sw, sum(w * x) as sx, sum(w * x * x) as sxx, sum(w * y) as sy, sum(w * x * y) as sxy
  from (select p.g, p.i, p.k, s.i - p.i as x, s.y, s.w * case when abs(s.i - p.i) <= 0.001 * h then 1
      when abs(s.i - p.i) <= 0.999 * h then power(1 - power(abs(s.i - p.i) / h, 3), 3) else 0 end as w
    from (select *, greatest(i - a, a + {span} - 1 - i) as h from (select g, i, k, greatest(0, least(i - {span // 2}, k - {span})) as a
      from (select g, k, unnest(range(-{ends}, k + {ends})) as i from (select g, count(*) as k from {source} group by 1)))) p
    join {source} s on s.g = p.g and s.i between p.a and p.a + {span} - 1) group by 1, 2, 3))"""


def _stl_sql(source, period, inner, outer):
    """CTEs that decompose (t, y), t from 0; the last one is `parts` (t, y, trend, seasonal)."""
    seasonal, trend, low = L.spans(period)
    steps, weights, before = [f"w0 as (select t, 1.0 as w from {source})"], "w0", f"(select t, 0.0 as v from {source})"
    for o in range(outer + 1):
        for r in range(inner):
            x = f"{o}_{r}"
            steps += [
                f"d{x} as materialized (select t % {period} as g, t // {period} as i, y - b.v as y, w from {source} join {before} b using (t) join {weights} using (t))",
                _lines_sql(f"c{x}", f"d{x}", seasonal, 1),
                f"e{x} as (select (i + 1) * {period} + g as t, v from c{x})",
                *(f"{new}{x} as materialized (select t, avg(v) over (order by t rows between current row and {width - 1} following) as v from {old}{x} qualify count(*) over (order by t rows between current row and {width - 1} following) = {width})"
                  for new, old, width in (("f", "e", period), ("h", "f", period), ("m", "h", 3))),
                f"s{x} as materialized (select 0 as g, t as i, v as y, 1.0 as w from m{x})",
                _lines_sql(f"l{x}", f"s{x}", low),
                f"q{x} as materialized (select l.i as t, e.v - l.v as v from l{x} l join e{x} e on e.t = l.i + {period})",
                f"u{x} as materialized (select 0 as g, t as i, y - q.v as y, w from {source} join q{x} q using (t) join {weights} using (t))",
                _lines_sql(f"n{x}", f"u{x}", trend), f"t{x} as materialized (select i as t, v from n{x})"]
            before = f"t{x}"
        steps.append(f"r{o} as materialized (select t, abs(y - a.v - b.v) as r, 6 * median(abs(y - a.v - b.v)) over () as h from {source} join {before} a using (t) join q{x} b using (t))")
        steps.append(f"w{o + 1} as materialized (select t, case when r <= 0.001 * h then 1.0 when r <= 0.999 * h then power(1 - power(r / h, 2), 2) else 0.0 end as w from r{o})")
        last, weights = weights, f"w{o + 1}"
    steps.append(f"parts as (select t, y, a.v as trend, b.v as seasonal, w as weight from {source} join {before} a using (t) join q{x} b using (t) join {last} using (t))")
    return ",\n".join(steps)


_DAYS = f"days as materialized (select row_number() over (order by day) - 1 as t, day, v as y from {DAILY})"


@query("stl_daily", f"""
with {_DAYS}, {_stl_sql("days", 7, 2, 2)}
select day, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(p.y - trend - seasonal, 4) as resid,
  round(weight, 5) + 0.0 as weight from parts p join days using (t)""")
def stl_daily(spark, folder):
    out = L.stl_decompose(daily(spark, folder), "v", 7, [], ["day"], outer=2)
    return _round(_round(out.drop("v"), 4, "trend", "seasonal", "resid"), 5, "weight")


@query("stl_anomalies", f"""
with {_DAYS}, {_stl_sql("days", 7, 2, 1)},
e as (select day, p.y - trend - seasonal as resid from parts p join days using (t)),
z as (select day, resid, (resid - (select avg(resid) from e)) / (select stddev_pop(resid) from e) as z from e)
select day, round(resid, 4) as resid, round(z, 4) as zscore from z where abs(z) > 2.5""")
def stl_anomalies(spark, folder):
    out = L.stl_anomalies(daily(spark, folder), "v", 7, [], ["day"], 2.5, outer=1)
    return _round(out, 4, "resid", "zscore")


@query("changepoints_of_trend")
def changepoints_of_trend(spark, folder):
    """Change points of the robust trend, with the full number of rounds."""
    trend = L.stl_decompose(daily(spark, folder), "v", 7, [], ["day"])
    out = G.optimal_segments(trend, "trend", [], ["day"], 2_000_000.0)
    return _round(out.drop("error"), 3, "level")
