"""Forecasts for many series at once: autoregressive, seasonal-naive, Fourier regression."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach_row, join_groups
from ..operators.ordered import number_rows, with_window
from .least_squares import fit_groups


def _sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def fit_ar(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str],
           p: int = 1) -> DataFrame:
    """(keys, n, beta, ...): conditional least squares on p lags, per series."""
    lagged = with_window(df.filter(F.col(value).isNotNull()), keys, order_by,
                         lambda w: {f"__l{i}": F.lag(value, i).over(w) for i in range(1, p + 1)}, back=p)
    return fit_groups(lagged.filter(F.col(f"__l{p}").isNotNull()),
                      [f"__l{i}" for i in range(1, p + 1)], value, keys)


def _last_values(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str],
                 n: int) -> DataFrame:
    """(keys, last): the last n values of each series, newest first."""
    numbered = number_rows(df, keys, order_by, "__rn")
    sized = (join_groups(numbered, _sizes(df, keys), keys, size="__n") if keys
             else numbered.withColumn("__n", F.lit(df.count())))
    tail = sized.filter(F.col("__rn") > F.col("__n") - n)
    return tail.groupBy(*keys).agg(F.reverse(F.transform(
        F.array_sort(F.collect_list(F.struct("__rn", F.col(value).cast("double").alias("v")))),
        lambda s: s["v"])).alias("last"))


def forecast_ar(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str],
                steps: int, p: int = 1, d: int = 0) -> DataFrame:
    """(keys, step, forecast): AR(p) on the d-times differenced series, integrated back (d <= 1)."""
    if d not in (0, 1):
        raise ValueError("d is 0 or 1")
    series = df.filter(F.col(value).isNotNull())
    work = series
    if d:
        work = with_window(series, keys, order_by, lambda w: {
            "__diff": F.col(value) - F.lag(value, 1).over(w)}, back=1).filter("__diff is not null")
    target = "__diff" if d else value
    fits = fit_ar(work, target, keys, order_by, p).drop("n", "stderr", "rss")
    start = _last_values(work, target, keys, order_by, p)
    both = join_groups(start, fits, keys) if keys else attach_row(start, fits)

    def step(state: Column, _: Column) -> Column:
        recent = F.slice(state, 1, p)
        made = F.aggregate(F.zip_with(F.slice("beta", 2, p), recent, lambda b, v: b * v),
                           F.get("beta", F.lit(0)), lambda a, t: a + t)
        return F.concat(F.array(made), state)

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("last"), step)
    out = both.select(*keys, F.reverse(F.slice(path, 1, steps)).alias("__path"))
    if d:
        level = _last_values(series, value, keys, order_by, 1).select(*keys, F.get("last", F.lit(0)).alias("__y"))
        out = join_groups(out, level, keys) if keys else attach_row(out, level)
        total = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda h: F.col("__y") + F.aggregate(
            F.slice("__path", 1, h), F.lit(0.0), lambda a, v: a + v))
        out = out.withColumn("__path", total)
    return out.select(*keys, F.posexplode("__path").alias("step", "forecast")).withColumn(
        "step", F.col("step") + 1)


def forecast_seasonal_naive(df: DataFrame, value: str, period: int, keys: Sequence[str],
                            order_by: Sequence[str], steps: int) -> DataFrame:
    """(keys, step, forecast): the value one season earlier, repeated."""
    last = _last_values(df, value, keys, order_by, period)
    h = F.sequence(F.lit(1), F.lit(steps))
    size = F.size("last")
    path = F.transform(h, lambda s: F.get("last", size - 1 - F.pmod(s - 1, size)))
    return last.select(*keys, F.posexplode(path).alias("step", "forecast")).withColumn(
        "step", F.col("step") + 1)


def fourier_terms(t: Column, period: float, order: int) -> dict[str, Column]:
    angle = t * F.lit(2 * pi / period)
    return {name: fn(angle * k) for k in range(1, order + 1)
            for name, fn in ((f"__sin{k}", F.sin), (f"__cos{k}", F.cos))}


def forecast_fourier(df: DataFrame, value: str, period: float, keys: Sequence[str],
                     order_by: Sequence[str], steps: int, order: int = 3, ridge: float = 0.0,
                     exog: Sequence[str] = (), future: DataFrame | None = None) -> DataFrame:
    """(keys, step, forecast): trend, Fourier seasonality and regressors, per series.

    With regressors, `future` holds (keys, step, exog...) for the steps to come.
    """
    if exog and future is None:
        raise ValueError("future values of the regressors are required")
    numbered = number_rows(df.filter(F.col(value).isNotNull()), keys, order_by, "__t")
    terms = fourier_terms(F.col("__t"), period, order)
    names = ["__t", *terms, *exog]
    fits = fit_groups(numbered.withColumns(terms), names, value, keys, ridge=ridge)
    if future is None:
        ahead = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    else:
        ahead = (join_groups(future, fits, keys) if keys
                 else attach_row(future, fits)).filter(F.col("step") <= steps)
    placed = ahead.withColumn("__t", F.col("n") + F.col("step"))
    placed = placed.withColumns(fourier_terms(F.col("__t"), period, order))
    made = F.get("beta", F.lit(0))
    for i, c in enumerate(names):
        made = made + F.get("beta", F.lit(i + 1)) * F.col(c)
    return placed.select(*keys, "step", made.alias("forecast"))


def validate_forecast(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str],
                      candidates: dict[str, object], test_size: int) -> DataFrame:
    """(keys, candidate, mae, rmse, mape, best): forecasts of each candidate against the tail.

    A candidate maps (training frame, steps) to (keys, step, forecast). The best one per
    series has the smallest squared error.
    """
    numbered = number_rows(df, keys, order_by, "__rn")
    sized = (join_groups(numbered, _sizes(df, keys), keys, size="__n") if keys
             else numbered.withColumn("__n", F.lit(df.count())))
    cut = F.col("__n") - test_size
    train = sized.filter(F.col("__rn") <= cut).drop("__rn", "__n")
    actual = sized.filter(F.col("__rn") > cut).select(
        *keys, (F.col("__rn") - cut).cast("int").alias("step"), F.col(value).alias("__y"))
    made = None
    for name, forecast in candidates.items():
        part = forecast(train, test_size).select(*keys, F.col("step").cast("int").alias("step"), "forecast",
                                                 F.lit(name).alias("candidate"))
        made = part if made is None else made.unionByName(part)
    error = F.col("__y") - F.col("forecast")
    scores = actual.join(made, [*keys, "step"]).groupBy(*keys, "candidate").agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(error / F.nullif(F.col("__y"), F.lit(0.0)))) * 100).alias("mape"))
    best = scores.groupBy(*keys).agg(F.min(F.struct("rmse", "candidate"))["candidate"].alias("__b"))
    joined = join_groups(scores, best, keys) if keys else attach_row(scores, best)
    return joined.withColumn("best", F.col("candidate") == F.col("__b")).drop("__b")
