"""Duplicate flags and removal. Nulls are equal; `keep` is first, last or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_groups
from .profile import require_columns

KEEP = ("first", "last", "none")


def _check(df: DataFrame, subset: Sequence[str], order_by: Sequence[str], keep: str) -> None:
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}")
    require_columns(df, [*subset, *order_by])
    if keep != "none" and not order_by:
        raise ValueError("order_by is required to say which row is first or last")


def duplicate_flags(df: DataFrame, subset: Sequence[str], order_by: Sequence[str] = (),
                    keep: str = "first", name: str = "is_duplicate") -> DataFrame:
    """Add a boolean; only keys that repeat are joined back."""
    _check(df, subset, order_by, keep)
    place = F.struct(*order_by) if order_by else F.lit(None)
    kept = {"first": F.min, "last": F.max, "none": F.max}[keep](place)
    repeated = (df.groupBy(*subset).agg(F.count(F.lit(1)).alias("__n"), kept.alias("__kept"))
                  .filter("__n > 1"))
    joined = join_groups(df, repeated, subset, size="__n")
    flag = F.col("__n").isNotNull()
    if keep != "none":
        flag = flag & ~place.eqNullSafe(F.col("__kept"))
    return joined.withColumn(name, flag).drop("__n", "__kept")


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                      order_by: Sequence[str] = (), keep: str = "first") -> DataFrame:
    """Whole-row duplicates without `subset`; otherwise one row (or none) per key.

    The kept row travels inside the aggregate, so copies collapse before the shuffle.
    """
    if not subset:
        if keep == "none":
            counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
            return counted.filter("__n = 1").select(*df.columns)
        return df.dropDuplicates()
    _check(df, subset, order_by, keep)
    row = F.struct(*df.columns)
    if keep == "none":
        groups = df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in subset]).agg(
            F.count(F.lit(1)).alias("__n"), F.any_value(row).alias("__row"))
        return groups.filter("__n = 1").select("__row.*")
    pick = F.min_by if keep == "first" else F.max_by
    groups = df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in subset]).agg(
        pick(row, F.struct(*order_by)).alias("__row"))
    return groups.select("__row.*")


def dedup_report(df: DataFrame, subset: Sequence[str] | None = None,
                 keep: str = "first") -> DataFrame:
    """(initial_rows, final_rows, duplicates_found, rows_removed, keep) from key counts alone."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    final = F.count_if(F.col("n") == 1) if keep == "none" else F.count(F.lit(1))
    counts = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("initial_rows"),
                        final.alias("final_rows"))
    removed = F.col("initial_rows") - F.col("final_rows")
    return counts.withColumns({"duplicates_found": removed, "rows_removed": removed,
                               "keep": F.lit(keep)})
