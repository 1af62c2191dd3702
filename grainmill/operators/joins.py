"""Joins of rows to per-group summaries, with the size of the small side checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, MAX_GROUP_ROWS, setting


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (totals, fitted values) as literals."""
    row = one_row.first()
    kinds = dict(one_row.dtypes)
    return df.withColumns({c: F.lit(row[c] if row else None).cast(kinds[c]) for c in one_row.columns})


def _on(rows: DataFrame, side: DataFrame, keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(side[f"__k_{k}"])
    return cond


def join_groups(rows: DataFrame, summary: DataFrame, keys: Sequence[str],
                size: str | None = None, how: str = "left") -> DataFrame:
    """Join rows to one summary row per key (nulls equal).

    A summary under the checked limit is broadcast. A larger one is joined in two
    parts: keys whose `size` exceeds the group limit are few, so they are broadcast
    and the hot rows never shuffle; the rest is an ordinary shuffle join.
    """
    side = summary.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    drop = [f"__k_{k}" for k in keys]
    spark = rows.sparkSession
    limit, broadcast_rows = setting(spark, MAX_GROUP_ROWS), setting(spark, BROADCAST_ROWS)
    is_hot = F.col(size) > limit if size is not None else F.lit(False)
    found = side.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_hot).alias("hot")).first()
    if found["all"] <= broadcast_rows:
        return rows.join(F.broadcast(side), _on(rows, side, keys), how).drop(*drop)
    if size is not None:
        hot = side.filter(is_hot)
        if 0 < found["hot"] <= broadcast_rows:
            cold = side.filter(F.col(size) <= limit)
            first = rows.join(F.broadcast(hot), _on(rows, hot, keys), "inner").drop(*drop)
            rest = rows.join(F.broadcast(hot.select(*drop)), _on(rows, hot, keys), "left_anti")
            second = rest.join(cold, _on(rest, cold, keys), how).drop(*drop)
            return first.unionByName(second)
    return rows.join(side, _on(rows, side, keys), how).drop(*drop)
