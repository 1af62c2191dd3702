"""Minimal composite keys: the smallest sets of columns whose values together identify a row.

Sets are searched level by level. One of n columns is looked at only if no part of it is a key. It cannot be a key if
the product of its parts' distinct counts stays below the number of rows, or if a sketch of its values is clearly below
it; one scan makes the sketches of a level. What is left is verified exactly, by grouping, and for that only rows
matter that are not yet alone under a part of the set: where these are few they are kept and the next level reads them
instead of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .profile import missing, require_columns

SKETCH_ERROR, SKETCH_MARGIN = 0.01, 0.06   # relative error of a sketch; what it must miss the rows by
SKETCHES_PER_PASS = 100
KEPT_SHARE = 0.1                           # rows not alone are kept up to this share of the table
KEY_SCHEMA = "columns array<string>, n_rows bigint"


def minimal_keys(df: DataFrame, columns: Sequence[str] | None = None, max_size: int = 3) -> DataFrame:
    """(columns, n_rows) of every minimal key of up to `max_size` columns. Columns with gaps are in no key.

    Columns of a key are listed in the order of the table. A table without rows has no keys.
    """
    columns = list(columns or df.columns)
    require_columns(df, columns)
    spark = df.sparkSession
    found = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, c)).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    rows = found["n"]
    columns = [c for i, c in enumerate(columns) if rows and not found[f"g{i}"]]
    keys: list[tuple[str, ...]] = []
    most: dict[tuple[str, ...], float] = {}         # no set has more distinct values
    rest: dict[tuple[str, ...], DataFrame] = {}     # rows that are not alone under a set, where they are few
    level = [(c,) for c in columns]
    while level:
        bounded = [s for s in level if _bound(s, most) >= rows]
        for s in level:
            most[s] = min(_bound(s, most), float(rows))
        for start in range(0, len(bounded), SKETCHES_PER_PASS):
            part = bounded[start:start + SKETCHES_PER_PASS]
            sizes = df.agg(*[F.approx_count_distinct(F.xxhash64(*s), SKETCH_ERROR).alias(f"d{i}") for i, s in enumerate(part)]).first()
            for i, s in enumerate(part):
                most[s] = min(most[s], sizes[f"d{i}"] * (1 + SKETCH_MARGIN))
        for s in bounded:
            if most[s] < rows:
                continue
            parts = [rest[p] for n in range(1, len(s)) for p in combinations(s, n) if p in rest]
            source = parts[-1] if parts else df
            groups = source.groupBy(*s).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
            again = groups.agg(F.sum("__n")).first()[0] or 0
            if not again:
                keys.append(s)
            elif again <= KEPT_SHARE * rows:
                same = groups.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(s)])
                on = [source[c] == same[f"__k{i}"] for i, c in enumerate(s)]
                rest[s] = cut_lineage(source.select(*columns).join(same, on, "left_semi"))
        level = _next_level(level, keys, columns) if len(level[0]) < max_size else []
    return spark.createDataFrame([(list(k), rows) for k in keys], KEY_SCHEMA)


def _bound(s: tuple[str, ...], most: dict[tuple[str, ...], float]) -> float:
    """Upper bound of the distinct values of a set by those of its parts."""
    best = float("inf")
    for n in range(1, len(s) // 2 + 1):
        for part in combinations(s, n):
            other = tuple(c for c in s if c not in part)
            if part in most and other in most:
                best = min(best, most[part] * most[other])
    return best


def _next_level(level: list[tuple[str, ...]], keys: list[tuple[str, ...]], columns: list[str]) -> list[tuple[str, ...]]:
    """Sets of one column more, all of whose parts were looked at and are no keys."""
    open_sets = {s for s in level if s not in keys}
    out = []
    for s in sorted(open_sets, key=lambda s: [columns.index(c) for c in s]):
        for c in columns[columns.index(s[-1]) + 1:]:
            wider = (*s, c)
            if all(p in open_sets for p in combinations(wider, len(s))):
                out.append(wider)
    return out
