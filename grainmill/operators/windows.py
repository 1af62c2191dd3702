"""Lag, rolling and sequence features; folds and hold-outs in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .joins import join_groups
from .ordered import number_rows, with_window

ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_features(df: DataFrame, columns: Sequence[str], lags: Sequence[int],
                 keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Add `<column>_lag_<k>`."""
    def make(w: WindowSpec) -> dict[str, Column]:
        return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags}

    return with_window(df, keys, order_by, make, back=max([0, *lags]), ahead=max([0, *[-k for k in lags]]))


def rolling_features(df: DataFrame, columns: Sequence[str], windows: Sequence[int],
                     keys: Sequence[str], order_by: Sequence[str],
                     stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    """Add `<column>_roll_<w>_<stat>`; null until the window holds `w` values."""
    unknown = [s for s in stats if s not in ROLLING]
    if unknown:
        raise ValueError(f"unknown statistics: {unknown}")

    def make(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in columns:
            for size in windows:
                frame = w.rowsBetween(-(size - 1), Window.currentRow)
                for s in stats:
                    out[f"{c}_roll_{size}_{s}"] = F.when(
                        F.count(c).over(frame) == size, ROLLING[s](c).over(frame))
        return out

    return with_window(df, keys, order_by, make, back=max(windows) - 1)


def sequence_windows(df: DataFrame, target: str, lookback: int, keys: Sequence[str],
                     order_by: Sequence[str], exog: Sequence[str] = ()) -> DataFrame:
    """Rows with `lookback` predecessors: their (target, exog...) as an array, plus the target."""
    def make(w: WindowSpec) -> dict[str, Column]:
        past = w.rowsBetween(-lookback, -1)
        return {"sequence": F.collect_list(F.struct(target, *exog)).over(past),
                "__seen": F.count(F.lit(1)).over(past)}

    return (with_window(df, keys, order_by, make, back=lookback)
            .filter(F.col("__seen") == lookback).drop("__seen"))


def _with_position(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    numbered = number_rows(df, keys, order_by, "__rn")
    if not keys:
        return numbered.withColumn("__n", F.lit(df.count()))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return join_groups(numbered, sizes, keys, size="__n")


def tail_holdout(df: DataFrame, n: int, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Add `split`: the last `n` rows of every series are validation."""
    placed = _with_position(df, keys, order_by)
    return (placed.withColumn("split", F.when(F.col("__rn") > F.col("__n") - n, "validation")
                              .otherwise("train")).drop("__rn", "__n"))


def timeseries_folds(df: DataFrame, n_splits: int, keys: Sequence[str],
                     order_by: Sequence[str]) -> DataFrame:
    """Add `fold`: 0 for rows that are only ever training, else the split that tests the row.

    Split f trains on rows with a smaller fold; the test size is n div (n_splits + 1).
    """
    placed = _with_position(df, keys, order_by)
    size = F.floor(F.col("__n") / (n_splits + 1))
    first = F.col("__n") - size * n_splits
    fold = F.when(F.col("__rn") <= first, 0).otherwise(
        F.floor((F.col("__rn") - first - 1) / F.nullif(size, F.lit(0))) + 1)
    return placed.withColumn("fold", fold.cast("int")).drop("__rn", "__n")


def trend_direction(df: DataFrame, value: str, keys: Sequence[str],
                    order_by: Sequence[str]) -> DataFrame:
    """(keys, first_value, last_value, direction) from the two ends of each series."""
    at = F.struct(*order_by)
    ends = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    return ends.withColumn("direction", F.when(F.col("last_value") > F.col("first_value"), "up")
                           .when(F.col("last_value") < F.col("first_value"), "down")
                           .otherwise("flat"))


def seasonal_difference(df: DataFrame, value: str, period: int, keys: Sequence[str],
                        order_by: Sequence[str], name: str = "seasonal_diff") -> DataFrame:
    return with_window(df, keys, order_by,
                       lambda w: {name: F.col(value) - F.lag(value, period).over(w)}, back=period)
