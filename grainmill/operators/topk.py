"""Top-k, paging, previews and down-sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import number_rows
from .profile import require_columns, top_values

MAX_CATEGORIES = 20       # fixed value: categories shown in a chart
MAX_POINTS = 1000         # fixed value: points shown in a chart
PAGE_SIZE = 100           # fixed value: default page
DRIVER_ROWS = 100_000     # offset + limit up to here is one bounded top-k


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def keep_top_categories(df: DataFrame, column: str, k: int = MAX_CATEGORIES) -> DataFrame:
    """Rows whose category is among the k most frequent (k rows are broadcast)."""
    top = top_values(df, column, k).select(F.col("value").alias("__top"))
    return df.join(F.broadcast(top), df[column] == top["__top"], "left_semi")


def top_with_other(df: DataFrame, column: str, value: str, k: int = MAX_CATEGORIES,
                   other: str = "Other") -> DataFrame:
    """(category, n, total): top-k categories by count, the rest added up as `other`."""
    per = df.groupBy(F.col(column).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    top = (per.filter("category is not null").orderBy(F.desc("n"), "category").limit(k)
              .select(F.col("category").alias("__top")))
    named = per.join(F.broadcast(top), F.col("category") == F.col("__top"), "left")
    return (named.withColumn("category", F.coalesce("__top", F.lit(other)))
                 .groupBy("category").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))


def page(df: DataFrame, order_by: Sequence[str], number: int, size: int = PAGE_SIZE,
         after: Sequence[object] | None = None) -> DataFrame:
    """Page `number` (from 1) in key order.

    `after` gives the last key of the page before and turns the request into a
    pushed-down range (keyset paging). Deep pages without it go through distributed
    row numbers rather than an offset held in one task.
    """
    require_columns(df, order_by)
    if not (number >= 1 and size >= 1):
        raise ValueError("page number and size begin at 1")
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for c, v in zip(order_by, after):
            beyond = beyond | (equal & (F.col(c) > F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        return df.filter(beyond).orderBy(*order_by).limit(size)
    first = (number - 1) * size
    if first + size <= DRIVER_ROWS:
        return df.orderBy(*order_by).offset(first).limit(size)
    numbered = number_rows(df, [], order_by, "__rn")
    return numbered.filter(F.col("__rn").between(first + 1, first + size)).drop("__rn")


def page_info(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.ceil(F.count(F.lit(1)) / size).alias("pages"))


def sample_points(df: DataFrame, key: Sequence[str], n: int = MAX_POINTS, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), chosen by a seeded hash of the key: repeatable on any layout."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; columns absent from one become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
