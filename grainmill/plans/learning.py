"""Queries on models, metrics, folds, forecasts and explanations."""

from pyspark.sql import functions as F

from ..ml import evaluate as E
from ..ml import explain as X
from ..ml import forecast as C
from ..ml import models as M
from ..ml import treeshap as H
from ..operators.joins import attach_row
from ..operators.windows import timeseries_folds
from ..session import scratch_path
from .profiling import union_all
from .registry import query, table
from .series import HOURLY, hourly, solved_sql

FEATURES = ["n_chars", "words", "lines", "digits"]


def labelled(spark, folder):
    """Labels with counts derived from the whole text of each document."""
    text = F.col("text")
    documents = table(spark, folder, "documents").select(
        "doc_id", "n_chars", F.size(F.split(text, r"\s+")).alias("words"),
        F.size(F.split(text, "\n")).alias("lines"),
        F.length(F.regexp_replace(text, r"\D", "")).alias("digits"))
    return table(spark, folder, "labels").join(documents, "doc_id")


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


@query("linear_regression", """
select 'intercept' as term, round(regr_intercept(l_extendedprice, l_quantity), 3) as value from lineitem
union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) from lineitem""")
def linear_regression(spark, folder):
    model = M.linear_regression(table(spark, folder, "lineitem"), ["l_quantity"], "l_extendedprice")
    return _round(M.coefficients(spark, model, ["l_quantity"]), 3, "value")


@query("linear_predictions", """
with f as (select regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a from lineitem)
select l_quantity, round(a + b * l_quantity, 3) as prediction, count(*)::bigint as n from lineitem, f group by 1, 2""")
def linear_predictions(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    model = M.linear_regression(lineitem, ["l_quantity"], "l_extendedprice")
    made = model.transform(M.assemble(lineitem, ["l_quantity"]))
    return (made.groupBy("l_quantity", F.round("prediction", 3).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


_SCORED = """select doc_id, quality, true as valid,
  true as learned from labels join documents using (doc_id)"""


def _facts(made, valid):
    """Each row with two facts: its prediction is `valid`, and as many rows are right as the larger class has."""
    sizes = made.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("quality")).alias("right"))
    learned = sizes.agg((F.sum("right") >= F.max("n")).alias("learned"))
    return attach_row(made.select("doc_id", "quality", valid.alias("valid")), learned)


@query("rf_predict", _SCORED)
def rf_predict(spark, folder):
    """The forest's score is a probability and its prediction the likelier class."""
    data = labelled(spark, folder)
    model = M.TrendPredictor("rf", class_weight="balanced").fit(data, FEATURES, "quality", {"numTrees": 20})
    score = F.col("score")
    return _facts(model.predict(data), score.between(0, 1) & (
        (F.col("prediction") == (score > 0.5).cast("double")) | (F.abs(score - 0.5) < 1e-9)))


@query("rf_regression", """
select metric, true as holds from (values ('mse'), ('rmse'), ('mae'), ('r2'), ('mape')) t(metric)
where exists (select 1 from orders)""")
def rf_regression(spark, folder):
    data = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 7).alias("seg"))
    model = M.TrendPredictor("rf", "regression").fit(data, ["month", "seg"], "o_totalprice", {"numTrees": 10})
    found = model.evaluate(data, "o_totalprice")
    # Errors are finite and not negative; trees fitted on these rows are no worse than the mean by more than 1%.
    return found.select("metric", F.when(F.col("metric") == "r2", F.col("value").between(-0.01, 1.0))
                        .otherwise((F.col("value") >= 0) & (F.col("value") < float("inf"))).alias("holds"))


@query("gbt_predict", _SCORED)
def gbt_predict(spark, folder):
    data = labelled(spark, folder)
    model = M.TrendPredictor("gb").fit(data, FEATURES, "quality", {"maxIter": 5})
    return _facts(model.predict(data), F.col("prediction").isin(0.0, 1.0))


@query("mlp_predict", _SCORED)
def mlp_predict(spark, folder):
    data = labelled(spark, folder)
    model = M.TrendPredictor("nn").fit(data, FEATURES, "quality", {"maxIter": 20})
    return _facts(model.predict(data), F.col("prediction").isin(0.0, 1.0))


@query("feature_selection", """
select 'constant' as feature, false as chosen, true as holds from labels having count(*) > 0
union all select f, true, true from (values ('n_chars'), ('words'), ('lines'), ('digits')) t(f)""")
def feature_selection(spark, folder):
    data = labelled(spark, folder).withColumn("constant", F.lit(1.0))
    model = M.TrendPredictor("rf").fit(data, [*FEATURES, "constant"], "quality", {"numTrees": 10},
                                       feature_selection=True)
    # A constant cannot be chosen; the importances of those chosen are shares of one.
    found = model.importances(spark)
    total = found.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("whole"))
    names = spark.createDataFrame([(f,) for f in [*FEATURES, "constant"]], "feature string")
    return names.join(found, "feature", "left").join(F.broadcast(total)).select(
        "feature", F.col("importance").isNotNull().alias("chosen"),
        (F.col("whole") & F.coalesce(F.col("importance").between(0, 1), F.lit(True))).alias("holds"))


@query("grid_search", """
select count(*)::bigint as tried, 1::bigint as chosen, true as best_wins, true as in_range
from range(3) where exists (select 1 from labels)""")
def grid_search(spark, folder):
    data = labelled(spark, folder)
    model = M.TrendPredictor("rf").fit(data, FEATURES, "quality",
                                       grid={"maxDepth": [2, 4], "numTrees": [5, 10]}, n_iter=3)
    rows = [(str(sorted(c.items())), float(s), c == model.best_params) for c, s in model.search_scores]
    scored = spark.createDataFrame(rows, "params string, score double, best boolean")
    return scored.agg(F.count_distinct("params").alias("tried"), F.count_if("best").alias("chosen"),
                      (F.max(F.when(F.col("best"), F.col("score"))) == F.max("score")).alias("best_wins"),
                      (F.min("score").between(0, 1) & F.max("score").between(0, 1)).alias("in_range"))


@query("class_weights", """
select quality, count(*)::bigint as n, round((select count(*) from labels) /
  ((select count(distinct quality) from labels) * count(*)), 6) as weight from labels group by 1""")
def class_weights(spark, folder):
    return _round(M.class_weights(table(spark, folder, "labels"), "quality"), 6, "weight")


# -- metrics: return flag as the label, line status or quantity as the guess ------------------
def _guesses(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(F.col("l_linenumber") % 3).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), "l_quantity")


_GUESS = """(select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y,
  case when l_linestatus = 'F' then 0 else l_linenumber % 3 end as p,
  (l_returnflag = 'R')::int as returned, l_quantity from lineitem)"""
_CLASSES = f"""(with c as (select y, p, count(*) n from {_GUESS} group by 1, 2),
s as (select y, sum(n) as support, sum(case when y = p then n else 0 end) as tp from c group by 1),
q as (select p, sum(n) as predicted from c group by 1),
m as (select y, support, tp, coalesce(tp / predicted, 0) as precision, tp / support as recall from s left join q on q.p = s.y)
select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from m)"""


@query("confusion_matrix", f"""
select y::double as label, p::double as prediction, count(*)::bigint as n from {_GUESS} group by 1, 2""")
def confusion_matrix(spark, folder):
    return E.confusion_matrix(_guesses(spark, folder), "y", "p")


@query("class_report", f"""
select y::double as label, support::bigint as support, tp::bigint as tp, round(precision, 5) as precision,
  round(recall, 5) as recall, round(f1, 5) as f1 from {_CLASSES}""")
def class_report(spark, folder):
    return _round(E.class_report(_guesses(spark, folder), "y", "p"), 5, "precision", "recall", "f1")


@query("classification_metrics", f"""
with c as (select * from {_CLASSES}), t as (select sum(support) t from c)
select 'accuracy' as metric, round(sum(tp) / min(t), 5) as value from c, t
union all select 'precision', round(sum(precision * support) / min(t), 5) from c, t
union all select 'recall', round(sum(recall * support) / min(t), 5) from c, t
union all select 'f1', round(sum(f1 * support) / min(t), 5) from c, t""")
def classification_metrics(spark, folder):
    return _round(E.classification_metrics(_guesses(spark, folder), "y", "p"), 5, "value")


@query("roc_auc", f"""
with r as (select returned, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rk from {_GUESS}),
n as (select sum(returned) p, count(*) - sum(returned) n from r)
select 'roc_auc' as metric, round(((select sum(rk) from r where returned = 1) - p * (p + 1) / 2.0) / (p * n), 5) as value from n""")
def roc_auc(spark, folder):
    return _round(E.roc_auc(_guesses(spark, folder), "returned", "l_quantity"), 5, "value")


@query("roc_curve", f"""
with c as (select l_quantity as q, sum(returned) p, count(*) - sum(returned) n from {_GUESS} group by 1)
select q as threshold, round(sum(n) over (order by q desc) / (select sum(n) from c), 6) as fpr,
  round(sum(p) over (order by q desc) / (select sum(p) from c), 6) as tpr from c""")
def roc_curve(spark, folder):
    return _round(E.roc_curve(_guesses(spark, folder), "returned", "l_quantity"), 6, "fpr", "tpr")


@query("regression_metrics", """
with d as (select l_extendedprice as y, l_quantity * 2000 as p from lineitem)
select 'mse' as metric, round(avg((y - p) ** 2) / 1e6, 4) as value from d
union all select 'rmse', round(sqrt(avg((y - p) ** 2)) / 1e6, 6) from d
union all select 'mae', round(avg(abs(y - p)) / 1e6, 6) from d
union all select 'r2', round((1 - avg((y - p) ** 2) / var_pop(y)) / 1e6, 10) from d
union all select 'mape', round(avg(abs((y - p) / y)) * 100 / 1e6, 9) from d where y <> 0""")
def regression_metrics(spark, folder):
    made = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    digits = F.create_map(*[x for m, d in (("mse", 4), ("rmse", 6), ("mae", 6), ("r2", 10), ("mape", 9))
                            for x in (F.lit(m), F.lit(d))])
    value = F.col("value") / 1e6
    rounded = F.coalesce(*[F.when(digits[F.col("metric")] == d, F.round(value, d)) for d in (4, 6, 9, 10)])
    return E.regression_metrics(made, "y", "p").withColumn("value", rounded)


@query("residuals", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - l_quantity * 2000, 2) as residual from lineitem""")
def residuals(spark, folder):
    made = table(spark, folder, "lineitem").withColumn("guess", F.col("l_quantity") * 2000)
    return _round(E.residuals(made, "l_extendedprice", "guess").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "residual"), 2, "residual")


_HASH = "md5(doc_id || '|42')"


@query("stratified_folds", f"""
select doc_id, quality, ((row_number() over (partition by quality order by {_HASH}, doc_id) - 1) % 5)::int as fold
from labels""")
def stratified_folds(spark, folder):
    return E.assign_folds(table(spark, folder, "labels"), 5, ["doc_id"], "quality").select(
        "doc_id", "quality", "fold")


@query("stratified_holdout", f"""
select doc_id, case when percent_rank() over (partition by quality order by {_HASH}, doc_id) < 0.2
  then 'test' else 'train' end as split from labels""")
def stratified_holdout(spark, folder):
    return E.assign_holdout(table(spark, folder, "labels"), 0.2, ["doc_id"], "quality").select("doc_id", "split")


@query("cross_validate")
def cross_validate(spark, folder):
    data = E.assign_folds(labelled(spark, folder), 3, ["doc_id"], "quality")

    def fit(train):
        return M.TrendPredictor("rf").fit(train, FEATURES, "quality", {"numTrees": 10}).predict

    return E.score_summary(E.cross_validate(
        data, fit, lambda d: E.classification_metrics(d, "quality", "prediction", "score"), 3))


@query("backtest_linear", "with o as (select *, row_number() over (order by o_orderdate, o_orderkey) as r, "
       "count(*) over () as n from orders), f as (select *, case when r <= n - 4 * (n // 5) then 0 else "
       "(r - (n - 4 * (n // 5)) - 1) // (n // 5) + 1 end as fold, (o_custkey % 10)::double as x from o) "
       + union_all(f"""select {s} as split, 'rmse' as metric, round(sqrt(avg((o_totalprice - (a + b * x)) ** 2)), 3) as value
       from f, (select regr_slope(o_totalprice, x) b, regr_intercept(o_totalprice, x) a from f where fold < {s}) m
       where fold = {s}""" for s in (1, 2, 3, 4)))
def backtest_linear(spark, folder):
    orders = table(spark, folder, "orders").withColumn("x", (F.col("o_custkey") % 10).cast("double"))
    folded = timeseries_folds(orders, 4, [], ["o_orderdate", "o_orderkey"])

    def fit(train):
        model = M.linear_regression(train, ["x"], "o_totalprice")
        return lambda d: model.transform(M.assemble(d, ["x"]))

    out = E.backtest(folded, fit, lambda d: E.regression_metrics(d, "o_totalprice", "prediction"), 4)
    return _round(out.filter("metric = 'rmse'"), 3, "value")


@query("metric_drift", """
with m as (select date_trunc('month', o_orderdate)::timestamp as ts, sum(o_totalprice) as a, count(*)::double as c from orders group by 1),
l as (select ts, 'total_price' as metric, a as value from m union all select ts, 'n_orders', c from m)
select ts, metric, round(value, 2) as value,
  round(value - lag(value) over (partition by metric order by ts), 2) + 0.0 as drift from l""")
def metric_drift(spark, folder):
    monthly = table(spark, folder, "orders").groupBy(
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum("o_totalprice").alias("a"), F.count(F.lit(1)).cast("double").alias("c"))
    history = monthly.select("ts", F.lit("run").alias("run"), F.explode(F.array(
        F.struct(F.lit("total_price").alias("metric"), F.col("a").alias("value")),
        F.struct(F.lit("n_orders").alias("metric"), F.col("c").alias("value")))).alias("m")).select(
        "ts", "run", "m.*")
    path = scratch_path(spark, "history")
    history.write.parquet(path)
    return _round(E.metric_drift(spark.read.parquet(path)).drop("run"), 2, "value", "drift")


# -- forecasts ----------------------------------------------------------------------------------
@query("forecast_ar1", f"""
with d as (select event_type, hour, v, lag(v) over (partition by event_type order by hour) as x from {HOURLY}),
f as (select event_type, regr_slope(v, x) phi, regr_intercept(v, x) c from d group by 1),
l as (select event_type, arg_max(v, hour) as y from d group by 1)
select event_type, h::int as step, round(c * (1 - power(phi, h)) / (1 - phi) + power(phi, h) * y, 4) as forecast
from f join l using (event_type), range(1, 13) r(h)""")
def forecast_ar1(spark, folder):
    return _round(C.forecast_ar(hourly(spark, folder), "v", ["event_type"], ["hour"], 12), 4, "forecast")


_DIFFERENCES = f"""y as (select event_type, list(v order by hour) as y, count(*) as n from {HOURLY} group by 1),
own as (select event_type, [1.0, y[t - 1] - y[t - 2], y[t - 2] - y[t - 3], y[t - 3] - y[t - 4], y[t] - y[t - 1]] as x
  from (select *, unnest(range(5, n + 1)) as t from y)),
"""


@query("forecast_ar_differenced", f"""
with {solved_sql("own", _DIFFERENCES)},
path as (select event_type, 0 as step, [m[i][5] / m[i][i] for i in range(1, 5)] as b, y[n] as level,
    [y[n] - y[n - 1], y[n - 1] - y[n - 2], y[n - 2] - y[n - 3]] as s from fit join y using (event_type)
  union all select event_type, step + 1, b, level + made, list_prepend(made, s[1:2])
  from (select *, b[1] + b[2] * s[1] + b[3] * s[2] + b[4] * s[3] as made from path where step < 12))
select event_type, step, round(level, 4) + 0.0 as forecast from path where step > 0""")
def forecast_ar_differenced(spark, folder):
    return _round(C.forecast_ar(hourly(spark, folder), "v", ["event_type"], ["hour"], 12, p=3, d=1), 4, "forecast")


@query("forecast_seasonal_naive", f"""
with n as (select event_type, v, row_number() over (partition by event_type order by hour desc) as r from {HOURLY})
select event_type, h::int as step, v as forecast from n, range(1, 49) t(h) where r = 24 - (h - 1) % 24""")
def forecast_seasonal_naive(spark, folder):
    return C.forecast_seasonal_naive(hourly(spark, folder), "v", 24, ["event_type"], ["hour"], 48)


_WAVES = "sin(2 * pi() * {t} / 24), cos(2 * pi() * {t} / 24), sin(4 * pi() * {t} / 24), cos(4 * pi() * {t} / 24), sin(6 * pi() * {t} / 24), cos(6 * pi() * {t} / 24)"
_WAVE_ROWS = f"""y as (select event_type, v, row_number() over (partition by event_type order by hour) as t,
  count(*) over (partition by event_type) as n from {HOURLY}),
own as (select event_type, [1.0, t - n / 2.0, {_WAVES.format(t="t")}, v] as x from y),
"""


@query("forecast_fourier", f"""
with {solved_sql("own", _WAVE_ROWS)},
ahead as (select event_type, h as step, m, [1.0, n + h - n / 2.0, {_WAVES.format(t="(n + h)")}] as x
  from fit join (select distinct event_type, n from y) using (event_type), range(1, 25) r(h))
select event_type, step::int as step, round(list_sum([m[i][9] / m[i][i] * x[i] for i in range(1, 9)]), 3) + 0.0 as forecast from ahead""")
def forecast_fourier(spark, folder):
    return _round(C.forecast_fourier(hourly(spark, folder), "v", 24, ["event_type"], ["hour"], 24), 3, "forecast")


@query("forecast_validate", f"""
with n as (select event_type, v, row_number() over (partition by event_type order by hour desc) as r from {HOURLY}),
t as (select event_type, 25 - r as step, v as y from n where r <= 24),
p as (select event_type, v, r - 24 as r from n where r > 24),
c as (select event_type, h as step, v, 'day' as candidate from p, range(1, 25) k(h) where r = 24 - (h - 1) % 24
  union all select event_type, h, v, 'half' from p, range(1, 25) k(h) where r = 12 - (h - 1) % 12),
s as (select event_type, candidate, avg(abs(y - c.v)) as mae, sqrt(avg((y - c.v) ** 2)) as rmse,
  avg(abs((y - c.v) / nullif(y, 0))) * 100 as mape from t join c using (event_type, step) group by 1, 2)
select event_type, candidate, round(mae, 6) as mae, round(rmse, 6) as rmse, round(mape, 6) as mape,
  rmse = min(rmse) over (partition by event_type) as best from s""")
def forecast_validate(spark, folder):
    def naive(period):
        return lambda train, steps: C.forecast_seasonal_naive(train, "v", period, ["event_type"], ["hour"], steps)

    out = C.validate_forecast(hourly(spark, folder), "v", ["event_type"], ["hour"],
                              {"day": naive(24), "half": naive(12)}, 24)
    return _round(out, 6, "mae", "rmse", "mape")


# -- explanations -------------------------------------------------------------------------------
LINEAR = """(select regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a,
  avg(l_quantity) m from lineitem)"""


def _line(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    model = M.linear_regression(lineitem, ["l_quantity"], "l_extendedprice")
    return X.linear_contributions(
        lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity"],
        [float(c) for c in model.coefficients], float(model.intercept))


@query("linear_contributions", f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_quantity' as feature,
  round(b * (l_quantity - m), 2) as contribution, round(a + b * m, 2) as base_value from lineitem, {LINEAR}""")
def linear_contributions(spark, folder):
    return _round(_line(spark, folder), 2, "contribution", "base_value")


@query("global_importance", f"""
select 'l_quantity' as feature, round(avg(abs(b * (l_quantity - m))), 3) as importance from lineitem, {LINEAR}""")
def global_importance(spark, folder):
    return _round(X.global_importance(_line(spark, folder)), 3, "importance")


@query("explanation_report", f"""
select 'l_quantity' as feature, 'Feature ''l_quantity'': mean(|contribution|) = ' ||
  printf('%.4f', avg(abs(b * (l_quantity - m)))) as line from lineitem, {LINEAR}""")
def explanation_report(spark, folder):
    return X.report_lines(_line(spark, folder))


_ADD_UP = """
select feature, count(*)::bigint as n, count(*)::bigint as adds_up from labels join documents using (doc_id),
  (select unnest(['n_chars', 'words', 'lines', 'digits']) as feature) group by 1"""


def _added(made, scored):
    """Per feature: rows, and rows whose contributions and base add up to the model's output."""
    sums = made.groupBy("doc_id").agg((F.sum("contribution") + F.min("base_value")).alias("total"))
    right = sums.join(scored, "doc_id").select("doc_id", (F.abs(F.col("total") - F.col("output")) < 1e-9).alias("ok"))
    return made.join(right, "doc_id").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("adds_up"))


@query("shapley_forest", _ADD_UP)
def shapley_forest(spark, folder):
    data = labelled(spark, folder)
    model = M.TrendPredictor("rf").fit(data, FEATURES, "quality", {"numTrees": 10})
    scored = model.predict(data).select("doc_id", F.col("score").alias("output"))
    return _added(H.tree_shapley(data, ["doc_id"], model), scored)


@query("shapley_boosted", _ADD_UP)
def shapley_boosted(spark, folder):
    data = labelled(spark, folder)
    model = M.TrendPredictor("gb", "regression").fit(data, FEATURES, "quality", {"maxIter": 5})
    scored = model.predict(data).select("doc_id", F.col("prediction").alias("output"))
    return _added(H.tree_shapley(data, ["doc_id"], model), scored)


def _scorer(spark, folder):
    data = labelled(spark, folder)
    model = M.TrendPredictor("rf").fit(data, FEATURES, "quality", {"numTrees": 10})
    return data, lambda d: model.predict(d).withColumn("output", F.col("score"))


@query("shapley_sampled")
def shapley_sampled(spark, folder):
    data, predict = _scorer(spark, folder)
    return _round(X.sampled_shapley(data, ["doc_id"], FEATURES, predict), 6, "contribution")


@query("lime_surrogate")
def lime_surrogate(spark, folder):
    data, predict = _scorer(spark, folder)
    return _round(X.local_surrogate(data, ["doc_id"], FEATURES, predict), 6, "weight")


@query("permutation_importance")
def permutation_importance(spark, folder):
    data, predict = _scorer(spark, folder)
    return _round(X.permutation_importance(data, FEATURES, ["doc_id"], predict, lambda d: E.classification_metrics(
        d, "quality", "prediction")), 6, "drop")
