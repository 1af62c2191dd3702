"""Ordered work inside groups of any size.

A window over a key puts all rows of that key in one task. That is right for
ordinary keys and wrong for a key holding a third of the table, or for no key
at all. Each function here measures the largest group first. Below the limit it
is a plain window. Above it the rows are range-partitioned by (key, order), so a
hot key spreads over many tasks; every task works on its own stretch, and a
summary row per (key, stretch) carries the state across the cuts.

`order_by` names plain columns, ascending, nulls first; together with the keys
they must identify a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import MAX_GROUP_ROWS, cut_lineage, setting

STRETCH = "__stretch"


def _check(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> None:
    if not order_by:
        raise ValueError("order_by is required: rows of a DataFrame have no order")
    absent = [c for c in [*keys, *order_by] if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")


def _spec(keys: Sequence[str], order_by: Sequence[str]) -> WindowSpec:
    # a constant stands for "no key"; only reached when the rows are few
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order_by)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the largest group): one pre-aggregated count over the key columns."""
    if not keys:
        n = df.count()
        return n, n
    row = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.sum("n").alias("total"), F.max("n").alias("top")).first())
    return row["total"] or 0, row["top"] or 0


def _stretch(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], rows: int) -> DataFrame:
    """Cut the (key, order) sequence into balanced stretches and freeze the cut."""
    limit = setting(df.sparkSession, MAX_GROUP_ROWS)
    parts = max(2, 2 * ceil(rows / limit))
    ranged = df.repartitionByRange(parts, *keys, *order_by)
    return cut_lineage(ranged.withColumn(STRETCH, F.spark_partition_id()))


def _is_hot(df: DataFrame, keys: Sequence[str]) -> tuple[bool, int]:
    rows, top = group_sizes(df, keys)
    return top > setting(df.sparkSession, MAX_GROUP_ROWS), rows


def _join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = summary.select(*[F.col(k).alias(f"__s_{k}") for k in [*keys, STRETCH]],
                             *[c for c in summary.columns if c not in (*keys, STRETCH)])
    on = F.lit(True)
    for k in [*keys, STRETCH]:
        on = on & rows[k].eqNullSafe(renamed[f"__s_{k}"])
    return rows.join(renamed, on, "left").drop(*[f"__s_{k}" for k in [*keys, STRETCH]])


def running_totals(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                   totals: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Add running sums; exclusive ones start at 0 and leave the current row out."""
    _check(df, keys, order_by)
    hot, rows = _is_hot(df, keys)
    values = df.withColumns({f"__v_{n}": e for n, e in totals.items()})

    def local(frame: DataFrame, spec: WindowSpec) -> DataFrame:
        end = 0 if inclusive else -1
        w = spec.rowsBetween(Window.unboundedPreceding, end)
        sums = {n: F.sum(f"__v_{n}").over(w) for n in totals}
        if not inclusive:
            sums = {n: F.coalesce(s, F.lit(0)) for n, s in sums.items()}
        return frame.withColumns(sums)

    drop = [f"__v_{n}" for n in totals]
    if not hot:
        return local(values, _spec(keys, order_by)).drop(*drop)
    cut = _stretch(values, keys, order_by, rows)
    w = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(STRETCH)
               .rowsBetween(Window.unboundedPreceding, -1))
    before = (cut.groupBy(*keys, STRETCH)
                 .agg(*[F.sum(f"__v_{n}").alias(f"__b_{n}") for n in totals])
                 .withColumns({f"__b_{n}": F.sum(f"__b_{n}").over(w) for n in totals}))
    joined = _join_summary(local(cut, _spec([*keys, STRETCH], order_by)), before, keys)
    return (joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"__b_{n}"), F.lit(0))
                                for n in totals})
                  .drop(*drop, *[f"__b_{n}" for n in totals], STRETCH))


def number_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                name: str = "row_number") -> DataFrame:
    """1-based position inside each group."""
    return running_totals(df, keys, order_by, {name: F.lit(1).cast("bigint")})


def with_window(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                make: Callable[[WindowSpec], dict[str, Column]],
                back: int = 0, ahead: int = 0) -> DataFrame:
    """Add window columns whose frames stay within `back` rows before and `ahead` rows after.

    For a hot group rows are numbered, cut into blocks, and each block is lent the
    few rows its frames can reach in the neighbouring blocks.
    """
    _check(df, keys, order_by)
    hot, _ = _is_hot(df, keys)
    if not hot:
        return df.withColumns(make(_spec(keys, order_by)))
    size = max(setting(df.sparkSession, MAX_GROUP_ROWS), back, ahead, 1)
    numbered = number_rows(df, keys, order_by, "__ordinal")
    place = numbered.withColumns({
        "__home": F.floor((F.col("__ordinal") - 1) / size),
        "__at": (F.col("__ordinal") - 1) % size,
    })
    blocks = F.array_compact(F.array(
        F.col("__home"),
        F.when(F.col("__at") >= size - back, F.col("__home") + 1),
        F.when((F.col("__at") < ahead) & (F.col("__home") > 0), F.col("__home") - 1)))
    lent = place.withColumn("__block", F.explode(blocks))
    spec = Window.partitionBy(*keys, "__block").orderBy("__ordinal")
    return (lent.withColumns(make(spec)).filter(F.col("__block") == F.col("__home"))
                .drop("__ordinal", "__home", "__at", "__block"))


def fill_ordered(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                 columns: Sequence[str], forward: bool = True) -> DataFrame:
    """Carry the last (forward) or next (backward) non-null value into nulls."""
    _check(df, keys, order_by)
    hot, rows = _is_hot(df, keys)
    frame = ((Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing))
    pick = F.last if forward else F.first

    def local(d: DataFrame, spec: WindowSpec) -> DataFrame:
        return d.withColumns({c: pick(c, ignorenulls=True).over(spec.rowsBetween(*frame))
                              for c in columns})

    if not hot:
        return local(df, _spec(keys, order_by))
    cut = _stretch(df, keys, order_by, rows)
    at = F.struct(*order_by)
    edge = F.max_by if forward else F.min_by
    ends = cut.groupBy(*keys, STRETCH).agg(
        *[edge(c, F.when(F.col(c).isNotNull(), at)).alias(f"__e_{c}") for c in columns])
    outer = ((Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(STRETCH).rowsBetween(*outer)
    ends = ends.withColumns({f"__e_{c}": pick(f"__e_{c}", ignorenulls=True).over(w)
                             for c in columns})
    joined = _join_summary(local(cut, _spec([*keys, STRETCH], order_by)), ends, keys)
    return (joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__e_{c}")) for c in columns})
                  .drop(STRETCH, *[f"__e_{c}" for c in columns]))
