"""Seasonal-trend decomposition by local regression, robust against outliers.

One round smooths every phase of the season along the cycles, takes the slow part out of it, and smooths what is left
as the trend; after some rounds rows far from their fit get less weight, and the rounds start again with these weights.
Local regression is a weighted line through the nearest rows, for all rows of a stretch at once.

A series of up to `grainmill.maxGroupRows` rows is decomposed in one task, all series side by side. A longer one is cut
into blocks. A round of smoothing looks only so many rows away, so a block is lent these rows on both sides and gives
the values of its own; the median that sets the weights is taken over the whole series between two rounds of weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import MAX_GROUP_ROWS, cut_lineage, setting
from .joins import join_groups
from .ordered import number_rows
from .timeseries import Z_RESIDUAL

SEASONAL, INNER, OUTER = 7, 2, 15        # fixed values: the usual defaults of the robust fit
INNER_PLAIN = 5                          # fixed value: rounds when no weights are learned
MISSING_WEIGHT = 1e-6                    # a missing value is interpolated and counts as so much of a row
WINDOW_CELLS = 1 << 21


def odd(x: float) -> int:
    n = ceil(x)
    return n + 1 if n % 2 == 0 else n


def spans(period: int, seasonal: int = SEASONAL, trend: int | None = None, low_pass: int | None = None) -> tuple[int, int, int]:
    """Lengths of the three smoothing windows, odd numbers."""
    if period < 2 or seasonal < 3 or seasonal % 2 == 0:
        raise ValueError("the period is 2 or more, the seasonal window odd and 3 or more")
    return seasonal, trend or odd(1.5 * period / (1 - 1.5 / seasonal)), low_pass or odd(period + 1)


def local_lines(y: np.ndarray, span: int, at: np.ndarray, extent: np.ndarray | float,
                weights: np.ndarray | None = None) -> np.ndarray:
    """(len(at), columns): for each place the value there of a weighted line through the `span` nearest rows of y.

    Weights fall with the distance as (1 - (d / h)^3)^3 and are multiplied by `weights`. Without any weight in a window
    the value itself is taken; where the weights stand within a thousandth of the series' `extent`, their mean.
    """
    n, width = len(y), min(span, len(y))
    out = np.empty((len(at), y.shape[1]))
    start = np.clip(at - (span - 1) // 2, 0, n - width)
    far = np.maximum(at - start, start + width - 1 - at) + max(0, (span - n) // 2)
    shift = np.arange(width)
    step = max(1, WINDOW_CELLS // (width * y.shape[1]))
    for a in range(0, len(at), step):
        place, first, reach = at[a:a + step], start[a:a + step], far[a:a + step][:, None]
        rows = first[:, None] + shift
        distance = np.abs(rows - place[:, None])
        near = np.where(distance <= 0.999 * reach, (1 - (distance / np.maximum(reach, 1e-300)) ** 3) ** 3, 0.0)
        near[distance <= 0.001 * reach] = 1.0
        w = np.repeat(near[:, :, None], y.shape[1], axis=2) if weights is None else near[:, :, None] * weights[rows]
        total = w.sum(axis=1)
        w /= np.where(total > 0, total, 1.0)[:, None]
        x = (rows - place[:, None])[:, :, None]
        middle = (w * x).sum(axis=1)
        spread = (w * (x - middle[:, None]) ** 2).sum(axis=1)
        tilt = np.where(np.sqrt(spread) > 0.001 * extent, -middle / np.where(spread > 0, spread, 1.0), 0.0)
        w *= 1 + tilt[:, None] * (x - middle[:, None])
        fit = (w * y[rows]).sum(axis=1)
        out[a:a + step] = np.where(total > 0, fit, y[np.clip(place, 0, n - 1)])
    return out


def running_mean(y: np.ndarray, width: int) -> np.ndarray:
    # differences of sums of the values less their mean, so that no digits are lost
    middle = y.mean()
    total = np.concatenate(([0.0], np.cumsum(y - middle)))
    return (total[width:] - total[:-width]) / width + middle


def smooth_phases(y: np.ndarray, period: int, span: int, weights: np.ndarray, first: int, whole: int) -> np.ndarray:
    """Each phase smoothed along the cycles and carried on by one cycle at both ends; y starts at row `first` of `whole`."""
    n = len(y)
    out = np.empty(n + 2 * period)
    longer = n % period or period  # phases that have one row more than the others
    for phases in (range(longer), range(longer, period)):
        cycles = len(range(phases.start, n, period)) if len(phases) else 0
        if not cycles:
            continue
        rows = np.arange(cycles)[:, None] * period + np.array(phases)
        extent = (whole - 1 - (first + np.array(phases)) % period) // period
        values = local_lines(y[rows], span, np.arange(-1, cycles + 1), extent, weights[rows])
        out[np.arange(cycles + 2)[:, None] * period + np.array(phases)] = values
    return out


def smoothing_rounds(y: np.ndarray, trend: np.ndarray, weights: np.ndarray, period: int, windows: tuple[int, int, int],
                     rounds: int, first: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) after some rounds of smoothing with given weights; y starts at row `first` of `whole`."""
    every = np.arange(len(y))
    season = np.zeros(len(y))
    for _ in range(rounds):
        cycle = smooth_phases(y - trend, period, windows[0], weights, first, whole)
        slow = running_mean(running_mean(running_mean(cycle, period), period), 3)
        season = cycle[period:-period] - local_lines(slow[:, None], windows[2], every, whole - 1)[:, 0]
        trend = local_lines((y - season)[:, None], windows[1], every, whole - 1, weights[:, None])[:, 0]
    return trend, season


def outlier_weights(rest: np.ndarray, median: float) -> np.ndarray:
    """Weights that fall with the size of the residual and are zero from six medians on."""
    limit = 6 * median
    size = np.abs(rest)
    w = np.where(size <= 0.999 * limit, (1 - (size / max(limit, 1e-300)) ** 2) ** 2, 0.0)
    w[size <= 0.001 * limit] = 1.0
    return w


def filled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values with gaps interpolated, and which were there."""
    there = ~np.isnan(values)
    if there.all() or not there.any():
        return np.where(there, values, 0.0), there
    places = np.arange(len(values))
    return np.interp(places, places[there], values[there]), there


def fit_series(values: np.ndarray, period: int, windows: tuple[int, int, int], inner: int, outer: int,
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, weight) of a whole series."""
    y, there = filled(values)
    base = np.where(there, 1.0, MISSING_WEIGHT)
    trend, weight = np.zeros(len(y)), np.ones(len(y))
    for k in range(outer + 1):
        trend, season = smoothing_rounds(y, trend, base * weight, period, windows, inner, 0, len(y))
        if k < outer:
            rest = y - trend - season
            weight = outlier_weights(rest, float(np.median(np.abs(rest[there]))) if there.any() else 0.0)
    return trend, season, weight


def stl_decompose(df: DataFrame, value: str, period: int, keys: Sequence[str], order_by: Sequence[str],
                  seasonal: int = SEASONAL, trend: int | None = None, low_pass: int | None = None, robust: bool = True,
                  inner: int | None = None, outer: int | None = None) -> DataFrame:
    """Add trend, seasonal, resid and weight (1, or less for outliers).

    Rows are taken to be evenly spaced in the given order; fill missing steps first (`calendar`). A NULL or NaN value is
    interpolated for the smoothing, with next to no weight, and has no residual. Series of fewer than two periods have
    NULLs.
    """
    windows = spans(period, seasonal, trend, low_pass)
    inner = inner if inner is not None else INNER if robust else INNER_PLAIN
    outer = outer if outer is not None else OUTER if robust else 0
    limit = setting(df.sparkSession, MAX_GROUP_ROWS)
    names = [f"__k{i}" for i in range(max(1, len(keys)))]
    numbered = number_rows(df.drop("trend", "seasonal", "resid", "weight"), keys, order_by, "__t")
    own = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("__k0")]
    v = F.col(value).cast("double")
    rows = numbered.select(*own, "__t", F.when(~F.isnan(v), v).alias("__v"))
    longest = rows.agg(F.max("__t")).first()[0] or 0
    if longest <= limit:
        fitted = _fit_whole(rows, names, period, windows, inner, outer)
    else:
        fitted = _fit_blocks(rows, names, period, windows, inner, outer, limit)
    left = numbered.select("*", *[o.alias(n) for o, n in zip(own, names)])
    right = fitted.withColumnsRenamed({n: f"__j{n}" for n in [*names, "__t"]})
    on = left["__t"] == right["__j__t"]
    for n in names:
        on = on & left[n].eqNullSafe(right[f"__j{n}"])
    parts = left.join(right, on, "left").drop(*names, *[f"__j{n}" for n in names], "__j__t", "__t")
    return parts.withColumn("resid", F.when(~F.isnan(v), v) - F.col("trend") - F.col("seasonal")).select(
        *[c for c in parts.columns if c not in ("trend", "seasonal", "weight")], "trend", "seasonal", "resid", "weight")


def _fit_whole(rows: DataFrame, names: Sequence[str], period: int, windows: tuple[int, int, int], inner: int, outer: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__t")
        values = table["__v"].to_numpy(zero_copy_only=False).astype(float)
        if len(values) < 2 * period:
            parts = [pa.nulls(len(values), pa.float64())] * 3
        else:
            parts = [pa.array(x) for x in fit_series(values, period, windows, inner, outer)]
        made = dict(zip(("trend", "seasonal", "weight"), parts))
        return pa.table({**{c: table[c] for c in [*names, "__t"]}, **made})

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*names, "__t"]) + ", trend double, seasonal double, weight double"
    return rows.groupBy(*names).applyInArrow(run, schema)


def _fit_blocks(rows: DataFrame, names: Sequence[str], period: int, windows: tuple[int, int, int], inner: int, outer: int,
                limit: int) -> DataFrame:
    """The same for series that are cut: a job for each round of weights."""
    # How far a value reaches: the season's window in cycles and one cycle beyond, the means, and both smoothers.
    reach = inner * ((windows[0] // 2 + 2) * period + 2 * period + 2 + windows[2] // 2 + 1 + windows[1] // 2 + 1)
    size = max(limit, 2 * reach)
    kinds = dict(rows.dtypes)
    state = ", ".join(f"{c} {kinds[c]}" for c in [*names, "__t"]) + ", __v double, trend double, seasonal double, weight double, __n bigint"
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    rows = join_groups(rows, sizes, names, size="__n")
    rows = _interpolated(rows, names)
    now = cut_lineage(rows.select(*names, "__t", "__v", "__y", F.lit(0.0).alias("trend"), F.lit(0.0).alias("seasonal"),
                                  F.lit(1.0).alias("weight"), "__n"))
    state = state.replace("__v double", "__v double, __y double")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__t")
        own = pa.array(table["__home"].to_numpy() == table["__block"].to_numpy())
        if table["__n"][0].as_py() < 2 * period:
            made = [pa.nulls(table.num_rows, pa.float64())] * 2
        else:
            y, trend, weight = (table[c].to_numpy(zero_copy_only=False).astype(float) for c in ("__y", "trend", "weight"))
            there = ~np.isnan(table["__v"].to_numpy(zero_copy_only=False).astype(float))
            made = [pa.array(x) for x in smoothing_rounds(
                y, trend, np.where(there, 1.0, MISSING_WEIGHT) * weight, period, windows, inner,
                table["__t"][0].as_py() - 1, table["__n"][0].as_py())]
        out = {c: table[c] for c in [*names, "__t", "__v", "__y"]} | {"trend": made[0], "seasonal": made[1]}
        return pa.table(out | {"weight": table["weight"], "__n": table["__n"]}).filter(own)

    home = F.floor((F.col("__t") - 1) / size)
    place = (F.col("__t") - 1) % size
    blocks = F.array_compact(F.array(home, F.when(place >= size - reach, home + 1),
                                     F.when((place < reach) & (home > 0), home - 1)))
    for k in range(outer + 1):
        lent = now.withColumns({"__home": home, "__block": F.explode(blocks)})
        now = cut_lineage(lent.groupBy(*names, "__block").applyInArrow(run, state))
        if k < outer:
            rest = F.abs(F.col("__y") - F.col("trend") - F.col("seasonal"))
            there = now.filter(F.col("__v").isNotNull()).select(*names, "__t", rest.alias("__r"))
            middle = _medians(there, names)
            joined = join_groups(now, middle, names)
            limit_ = 6 * F.col("__median")
            share = F.col("__rest") / limit_
            weight = (F.when(F.col("__rest") <= 0.001 * limit_, 1.0)
                      .when(F.col("__rest") <= 0.999 * limit_, (1 - share * share) * (1 - share * share)).otherwise(0.0))
            now = joined.withColumn("__rest", rest).withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("__rest", "__median")
    whole = F.col("__n") >= 2 * period
    return now.select(*names, "__t", *[F.when(whole, F.col(c)).alias(c) for c in ("trend", "seasonal", "weight")])


def _interpolated(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add __y: the value, or what lies between the neighbouring values."""
    from .ordered import fill_ordered

    at = F.when(F.col("__v").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    both = rows.withColumns({"__a": at, "__b": at})
    both = fill_ordered(both, names, ["__t"], ["__a"])
    both = fill_ordered(both, names, ["__t"], ["__b"], forward=False)
    a, b = F.coalesce("__a", "__b"), F.coalesce("__b", "__a")
    slope = F.coalesce(F.try_divide(b["v"] - a["v"], (b["t"] - a["t"]).cast("double")), F.lit(0.0))
    between = F.when(F.col("__t") < a["t"], a["v"]).otherwise(a["v"] + slope * (F.col("__t") - a["t"]))
    return both.withColumn("__y", F.coalesce("__v", between, F.lit(0.0))).drop("__a", "__b")


def _medians(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """(keys, __median) of __r, by position in sorted order, for groups of any size."""
    placed = number_rows(values, names, ["__r", "__t"], "__p")
    sizes = values.groupBy(*names).agg(F.count(F.lit(1)).alias("__c"))
    joined = join_groups(placed, sizes, names, size="__c")
    half = F.floor((F.col("__c") + 1) / 2)
    return joined.filter((F.col("__p") == half) | (F.col("__p") == F.col("__c") + 1 - half)).groupBy(*names).agg(
        F.avg("__r").alias("__median"))


def stl_anomalies(df: DataFrame, value: str, period: int, keys: Sequence[str], order_by: Sequence[str],
                  z_thresh: float = Z_RESIDUAL, **options) -> DataFrame:
    """(keys, order columns, resid, zscore) where the residual of the decomposition lies far from the others."""
    parts = stl_decompose(df, value, period, keys, order_by, **options).filter("resid is not null")
    stats = parts.groupBy(*keys).agg(F.avg("resid").alias("__m"), F.stddev_pop("resid").alias("__sd"), F.count(F.lit(1)).alias("__n"))
    scored = join_groups(parts, stats, keys, size="__n") if keys else parts.join(F.broadcast(stats))
    z = F.try_divide(F.col("resid") - F.col("__m"), F.col("__sd"))
    return scored.withColumn("zscore", z).filter(F.abs("zscore") > z_thresh).select(*keys, *order_by, "resid", "zscore")
