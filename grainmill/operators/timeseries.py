"""Time series in the form (keys, order columns, value): many series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..ml.least_squares import fit_groups
from ..session import cut_lineage
from .joins import attach_row, join_groups
from .ordered import number_rows, running_totals, with_window

# Seasonal period per sampling unit, in seconds, and the size-based fallback.
PERIODS = {
    60: 60,          # minutes
    3600: 24,        # hours
    86400: 7,        # days
    604800: 52,      # weeks
}
MONTH_PERIOD, QUARTER_PERIOD, YEAR_PERIOD = 12, 4, 1
Z_RESIDUAL = 3.0
CHANGE_PENALTY = 10.0
KPSS_5PCT = 0.463    # published critical value, level stationarity
ADF_5PCT = -2.86     # published asymptotic critical value, constant only


def infer_period(df: DataFrame, ts: str, keys: Sequence[str] = (),
                 tie: Sequence[str] = ()) -> DataFrame:
    """(keys, n, gap_seconds, period) from the most frequent gap between neighbouring points."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    gaps = with_window(df, keys, [ts, *tie], lambda w: {
        "__gap": seconds - F.lag(seconds, 1).over(w)}, back=1)
    counts = gaps.groupBy(*keys, "__gap").agg(F.count(F.lit(1)).alias("__c"))
    mode = counts.groupBy(*keys).agg(
        F.sum("__c").alias("n"),
        F.min(F.when(F.col("__gap").isNotNull(), F.struct((-F.col("__c")).alias("neg"), "__gap"))
              ).alias("m"))
    gap = F.col("m.__gap")
    day = gap / 86400
    unit = F.lit(None).cast("int")
    for size, period in PERIODS.items():
        unit = F.when(gap == size, period).otherwise(unit)
    unit = (F.when(day.between(28, 31), MONTH_PERIOD).when(day.between(90, 92), QUARTER_PERIOD)
             .when(day.between(365, 366), YEAR_PERIOD).otherwise(unit))
    fallback = F.when(F.col("n") > 730, 365).when(F.col("n") > 60, 12).otherwise(7)
    return mode.select(*keys, "n", gap.alias("gap_seconds"),
                       F.coalesce(unit, fallback).cast("int").alias("period"))


def calendar(df: DataFrame, ts: str, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ts): every step between the ends of each series; join it to fill missing steps."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    steps = F.sequence(F.date_trunc(unit, "__lo"), F.date_trunc(unit, "__hi"),
                       F.expr(f"interval 1 {unit}"))
    return ends.select(*keys, F.explode(steps).alias(ts)).withColumn(
        ts, F.col(ts).cast("timestamp_ntz"))


def decompose(df: DataFrame, value: str, period: int, keys: Sequence[str],
              order_by: Sequence[str]) -> DataFrame:
    """Add trend, seasonal and resid: classical additive decomposition.

    Trend is a centred moving average (two half-weights at the ends for an even period);
    seasonal is the mean detrended value per phase, centred to sum zero.
    """
    half = period // 2
    positioned = number_rows(df, keys, order_by, "__rn")

    def make(w: WindowSpec) -> dict[str, Column]:
        if period % 2:
            frame = w.rowsBetween(-half, half)
            return {"trend": F.when(F.count(value).over(frame) == period, F.avg(value).over(frame))}
        inner, outer = w.rowsBetween(-(half - 1), half - 1), w.rowsBetween(-half, half)
        ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        mid = F.sum(value).over(inner)
        return {"trend": F.when(F.count(value).over(outer) == period + 1, (mid + ends / 2) / period)}

    trended = with_window(positioned, keys, order_by, make, back=half, ahead=half)
    phase = trended.withColumn("__phase", (F.col("__rn") - 1) % period)
    means = phase.groupBy(*keys, "__phase").agg(F.avg(F.col(value) - F.col("trend")).alias("__s"))
    centre = Window.partitionBy(*(keys or [F.lit(0)]))  # at most `period` rows per series
    means = means.withColumn("seasonal", F.col("__s") - F.avg("__s").over(centre)).drop("__s")
    joined = join_groups(phase, means, [*keys, "__phase"])
    return joined.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal")).drop(
        "__phase", "__rn")


def residual_anomalies(df: DataFrame, value: str, period: int, keys: Sequence[str],
                       order_by: Sequence[str], z_thresh: float = Z_RESIDUAL) -> DataFrame:
    """(keys, order columns, resid, zscore) where the residual's abs z exceeds the threshold."""
    parts = decompose(df, value, period, keys, order_by).filter("resid is not null")
    stats = parts.groupBy(*keys).agg(F.avg("resid").alias("__m"), F.stddev_pop("resid").alias("__sd"),
                                     F.count(F.lit(1)).alias("__n"))
    scored = join_groups(parts, stats, keys, size="__n") if keys else attach_row(parts, stats)
    z = F.try_divide(F.col("resid") - F.col("__m"), F.col("__sd"))
    return scored.withColumn("zscore", z).filter(F.abs("zscore") > z_thresh).select(
        *keys, *order_by, "resid", "zscore")


def changepoints(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str],
                 penalty: float = CHANGE_PENALTY, max_depth: int | None = None) -> DataFrame:
    """(keys, segment, position, gain): mean shifts by binary segmentation.

    One round splits every open segment of every series at its best point, if that lowers
    the squared error by more than the penalty; the next round looks at both halves. It goes on until no
    segment splits, or for `max_depth` rounds.
    """
    numbered = number_rows(df.filter(F.col(value).isNotNull()), keys, order_by, "position")
    base = numbered.select(*keys, "position", F.col(value).cast("double").alias("__v"))
    segmented = base.withColumn("segment", F.lit(1).cast("bigint"))
    found = None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        group = [*keys, "segment"]
        totals = segmented.groupBy(*group).agg(
            F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__t"), F.min("position").alias("__p0"))
        run = running_totals(segmented, group, ["position"], {"__left": F.col("__v")}, inclusive=False)
        joined = join_groups(run, totals, group, size="__n")
        k = (F.col("position") - F.col("__p0")).cast("double")
        rest = F.col("__n") - k
        delta = F.try_divide(F.col("__left"), k) - F.try_divide(F.col("__t") - F.col("__left"), rest)
        gain = k * rest / F.col("__n") * delta * delta
        best = joined.filter(k > 0).groupBy(*group).agg(
            F.max(F.struct(gain.alias("gain"), (-F.col("position")).alias("neg"))).alias("b"))
        splits = best.filter(F.col("b.gain") > penalty).select(
            *group, (-F.col("b.neg")).alias("split"), F.col("b.gain").alias("gain"))
        splits = cut_lineage(splits)
        if splits.isEmpty():
            break
        level = splits.select(*keys, "segment", F.col("split").alias("position"), "gain")
        found = level if found is None else found.unionByName(level)
        segmented = (join_groups(segmented, splits.drop("gain"), group)
                     .filter("split is not null")  # closed segments are not searched again
                     .withColumn("segment", F.col("segment") * 2 + (F.col("position") >= F.col("split")).cast("bigint"))
                     .drop("split"))
        segmented = cut_lineage(segmented)
    if found is None:
        return base.select(*keys, F.lit(1).cast("bigint").alias("segment"), "position",
                           F.lit(0.0).alias("gain")).limit(0)
    return found


def kpss(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str],
         lags: int = 0) -> DataFrame:
    """(keys, n, statistic, stationary): KPSS level test with Bartlett weights."""
    clean = df.filter(F.col(value).isNotNull())
    mean = clean.groupBy(*keys).agg(F.avg(value).alias("__m"), F.count(F.lit(1)).alias("__n"))
    centred = join_groups(clean, mean, keys, size="__n") if keys else attach_row(clean, mean)
    centred = centred.withColumn("__e", F.col(value) - F.col("__m"))
    sums = running_totals(centred, keys, order_by, {"__s": F.col("__e")})
    if lags:
        sums = with_window(sums, keys, order_by, lambda w: {
            f"__l{j}": F.lag("__e", j).over(w) for j in range(1, lags + 1)}, back=lags)
    e = F.col("__e")
    variance = F.sum(e * e)
    for j in range(1, lags + 1):
        variance = variance + 2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(e * F.col(f"__l{j}")), F.lit(0.0))
    n = F.count(F.lit(1)).cast("double")
    out = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(F.col("__s") * F.col("__s")) / (n * n), variance / n).alias("statistic"))
    return out.withColumn("stationary", F.col("statistic") < KPSS_5PCT)


def adf(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str],
        lags: int = 0) -> DataFrame:
    """(keys, n, statistic, stationary): Dickey-Fuller with a constant and fixed lagged differences.

    With no lagged difference the regression has closed form; with lags the small normal
    equations of each series are solved after one aggregate.
    """
    clean = df.filter(F.col(value).isNotNull())
    y = F.col(value).cast("double")
    made = with_window(clean, keys, order_by, lambda w: {
        "__y1": F.lag(y, 1).over(w),
        **{f"__y{j + 1}": F.lag(y, j + 1).over(w) for j in range(1, lags + 1)}}, back=lags + 1)
    rows = made.filter(F.col(f"__y{lags + 1}").isNotNull()).withColumn("__d", y - F.col("__y1"))
    names = ["__y1"]
    for j in range(1, lags + 1):
        rows = rows.withColumn(f"__d{j}", F.col(f"__y{j}") - F.col(f"__y{j + 1}"))
        names.append(f"__d{j}")
    n = F.count(F.lit(1)).cast("double")
    if not lags:
        sxx, sxy = F.var_pop("__y1") * n, F.covar_pop("__y1", "__d") * n
        syy = F.var_pop("__d") * n
        fit = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sxx.alias("sxx"),
                                      sxy.alias("sxy"), syy.alias("syy"))
        slope = F.try_divide(F.col("sxy"), F.col("sxx"))
        rss = F.col("syy") - slope * F.col("sxy")
        se = F.sqrt(F.try_divide(F.try_divide(rss, F.col("n") - 2), F.col("sxx")))
        out = fit.select(*keys, "n", F.try_divide(slope, se).alias("statistic"))
    else:
        fit = fit_groups(rows, names, "__d", keys)
        out = fit.select(*keys, "n", F.try_divide(F.get("beta", F.lit(1)), F.get("stderr", F.lit(1)))
                         .alias("statistic"))
    return out.withColumn("stationary", F.col("statistic") < ADF_5PCT)
