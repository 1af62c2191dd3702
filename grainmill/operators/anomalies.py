"""Statistical anomaly flags. Limits are learned in a bounded aggregate, then used as literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import numeric_columns, require_columns
from .quantiles import as_double, exact_quantiles

Z_THRESHOLD = 3.0    # fixed value
IQR_FACTOR = 1.5     # fixed value
TINY = 1e-9          # fixed value: keeps the severity finite on a zero range


def _threshold(threshold: float | Mapping[str, float] | None, column: str, default: float) -> float:
    if threshold is None:
        return default
    if isinstance(threshold, Mapping):
        return threshold.get(column, default)
    return threshold


def _records(df: DataFrame, row_id: Sequence[str], records: Sequence[Column]) -> DataFrame:
    exploded = df.select(*row_id, F.explode(F.array_compact(F.array(*records))).alias("r"))
    return exploded.select(*row_id, "r.*")


def _record(column: str, score: Column, severity: Column) -> Column:
    return F.struct(F.lit(column).alias("column"), score.alias("score"), severity.alias("severity"))


def z_columns(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> dict[str, Column]:
    """abs((x - mean) / std) per column; null for missing values and constant columns."""
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = df.agg(*[f(as_double(df, c)).alias(f"{n}_{i}") for i, c in enumerate(columns)
                     for n, f in (("m", F.avg), ("s", spread))]).first()

    def z(i: int, c: str) -> Column:
        mean, std = stats[f"m_{i}"], stats[f"s_{i}"]
        if mean is None or not std:
            return F.lit(None).cast("double")
        return F.abs((as_double(df, c) - F.lit(mean)) / F.lit(std))

    return {c: z(i, c) for i, c in enumerate(columns)}


def zscore_anomalies(df: DataFrame, row_id: Sequence[str], columns: Sequence[str] | None = None,
                     threshold: float | Mapping[str, float] | None = None,
                     mode: str = "per_column", ddof: int = 0) -> DataFrame:
    """(row_id, column, score, severity) of values beyond the z threshold.

    `combined` flags a row by its largest z and reports it for every column; a row with any
    missing value is skipped.
    """
    columns = list(columns or numeric_columns(df))
    require_columns(df, [*row_id, *columns])
    z = z_columns(df, columns, ddof)
    if mode == "per_column":
        return _records(df, row_id, [
            F.when(z[c] > _threshold(threshold, c, Z_THRESHOLD), _record(c, z[c], z[c]))
            for c in columns])
    whole = reduce(lambda a, b: a & b, [z[c].isNotNull() for c in columns])
    top = F.greatest(*z.values()) if len(columns) > 1 else z[columns[0]]
    hits = df.withColumn("__z", F.when(whole, top))
    over = reduce(lambda a, b: a | b, [
        z[c] > _threshold(threshold, c, Z_THRESHOLD) for c in columns])
    return _records(hits.filter(F.col("__z").isNotNull() & over), row_id,
                    [_record(c, F.col("__z"), F.col("__z")) for c in columns])


def iqr_bounds(df: DataFrame, columns: Sequence[str],
               threshold: float | Mapping[str, float] | None = None) -> dict[str, tuple]:
    """(lower, upper, iqr) per column that has values."""
    found = exact_quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c in columns:
        q1, q3 = found[c]
        if q1 is not None:
            t = _threshold(threshold, c, IQR_FACTOR)
            out[c] = (q1 - t * (q3 - q1), q3 + t * (q3 - q1), q3 - q1)
    return out


def outside(df: DataFrame, column: str, bounds: tuple) -> Column:
    v = as_double(df, column)
    return F.coalesce((v < F.lit(bounds[0])) | (v > F.lit(bounds[1])), F.lit(False))


def iqr_anomalies(df: DataFrame, row_id: Sequence[str], columns: Sequence[str] | None = None,
                  threshold: float | Mapping[str, float] | None = None,
                  mode: str = "per_column") -> DataFrame:
    """(row_id, column, score, severity) of values outside the quartile fences.

    per_column: score is the value; combined: score is the number of columns outside.
    """
    columns = list(columns or numeric_columns(df))
    require_columns(df, [*row_id, *columns])
    bounds = iqr_bounds(df, columns, threshold)
    if mode == "per_column":
        records = []
        for c, (lo, hi, iqr) in bounds.items():
            v = as_double(df, c)
            severity = F.greatest(F.abs(v - lo), F.abs(v - hi)) / F.lit(iqr + TINY)
            records.append(F.when(outside(df, c, (lo, hi)), _record(c, v, severity)))
        return _records(df, row_id, records)
    score = reduce(lambda a, b: a + b, [outside(df, c, b).cast("double") for c, b in bounds.items()])
    return _records(df.withColumn("__s", score).filter("__s > 0"), row_id, [
        _record(c, F.col("__s"), F.col("__s") / len(columns)) for c in columns])


def iqr_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add `<column>_anomaly` booleans; missing values are not anomalies."""
    columns = list(columns or numeric_columns(df))
    bounds = iqr_bounds(df, columns)
    return df.withColumns({f"{c}_anomaly": outside(df, c, bounds[c]) if c in bounds else F.lit(False)
                           for c in columns})
