"""Exact quantiles, modes and distinct counts that stay bounded on any table.

Spark's exact `percentile` and `mode` keep a value-to-count map per group in one
task. Up to a row limit that is the fastest way. Beyond it, quantiles are found
by narrowing value ranges: every pass is one scan with a small pre-aggregated
histogram, and no data row is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor, isinf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import EXACT_PERCENTILE_ROWS, setting

BINS = 1024
LAST_ROWS = 20_000  # rows whose values may be listed on the driver to end a search


def as_double(df: DataFrame, c: str) -> Column:
    """Numbers and timestamps as doubles; NaN counts as missing."""
    kind = dict(df.dtypes)[c]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    value = F.col(c).cast("double")
    return F.when(F.isnan(value), None).otherwise(value) if kind in ("double", "float") else value


def _bin(v: Column, lo: float, hi: float) -> Column:
    """Bin of a value inside [lo, hi]; always separates the two ends."""
    width = (hi - lo) / BINS
    if isinf(width) or width == 0.0:
        return F.when(v == lo, 0).when(v == hi, 2).otherwise(1).cast("bigint")
    return F.least(F.floor((v - lo) / width), F.lit(BINS - 1))


def exact_quantiles(df: DataFrame, columns: Sequence[str],
                    probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column (one short list per column on the driver)."""
    columns = list(columns)
    if not columns:
        return {}
    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]
    limit = setting(df.sparkSession, EXACT_PERCENTILE_ROWS)
    stats = values.agg(*[f(n).alias(f"{t}_{n}") for n in names
                         for t, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    if all(stats[f"n_{n}"] <= limit for n in names):
        row = values.agg(*[F.percentile(n, F.array(*[F.lit(float(p)) for p in probs])).alias(n)
                           for n in names]).first()
        return {c: list(row[n]) if row[n] is not None else [None] * len(probs)
                for c, n in zip(columns, names)}

    wanted: dict[tuple[str, int], float | None] = {}
    brackets: dict[tuple[str, int], tuple[float, float, int, int]] = {}
    for n in names:
        count = stats[f"n_{n}"]
        for p in probs if count else ():
            for rank in {floor(p * (count - 1)), ceil(p * (count - 1))}:
                ends = {0: stats[f"lo_{n}"], count - 1: stats[f"hi_{n}"]}
                wanted[(n, rank)] = ends.get(rank)
                if rank not in ends:
                    brackets[(n, rank)] = (stats[f"lo_{n}"], stats[f"hi_{n}"], 0, count)
    while brackets:
        for key in [k for k, (lo, hi, _, _) in brackets.items() if lo == hi]:
            wanted[key] = brackets.pop(key)[0]
        spans = sorted({(n, lo, hi) for (n, _), (lo, hi, _, _) in brackets.items()})
        if not spans:
            break
        inside = [F.col(n).between(lo, hi) for n, lo, hi in spans]
        # few rows left: their values are the bins, and this pass is the last
        few = sum({(n, lo, hi): held for (n, _), (lo, hi, _, held) in brackets.items()}.values()) <= LAST_ROWS
        hits = F.array_compact(F.array(*[
            F.when(inside[i], F.struct(F.lit(i).alias("span"), F.col(n).alias("v"), (
                F.lit(0).cast("bigint") if few else _bin(F.col(n), lo, hi)).alias("bin")))
            for i, (n, lo, hi) in enumerate(spans)]))
        near = values.filter(reduce(lambda a, b: a | b, inside)).select(F.explode(hits).alias("h")).select("h.*")
        grouped = near.groupBy("span", *(["v"] if few else ["bin"])).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counts: dict[int, list] = {}
        for row in sorted(grouped.collect(), key=lambda r: (r["span"], r["lo"])):
            counts.setdefault(row["span"], []).append(row)
        for key, (lo, hi, below, _) in list(brackets.items()):
            for row in counts[spans.index((key[0], lo, hi))]:
                if below + row["n"] > key[1]:
                    brackets[key] = (row["lo"], row["hi"], below, row["n"])
                    break
                below += row["n"]
    result: dict[str, list[float | None]] = {}
    for c, n in zip(columns, names):
        count = stats[f"n_{n}"]
        row = []
        for p in probs:
            if not count:
                row.append(None)
                continue
            at = p * (count - 1)
            lo, hi = wanted[(n, floor(at))], wanted[(n, ceil(at))]
            row.append(lo + (hi - lo) * (at - floor(at)))
        result[c] = row
    return result


def value_counts(df: DataFrame, columns: Sequence[str], as_text: bool = True) -> DataFrame:
    """(column, value, n) without nulls: one scan, counts combined before the shuffle."""
    def cast(c: str) -> Column:
        return F.col(c).cast("string") if as_text else as_double(df, c)

    pairs = F.array(*[F.struct(F.lit(i).alias("i"), cast(c).alias("value"))
                      for i, c in enumerate(columns)])
    counts = (df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")
                .groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(F.get(names, F.col("i")).alias("column"), "value", "n")


def modes(df: DataFrame, columns: Sequence[str], as_text: bool = True) -> DataFrame:
    """(column, mode, freq): most frequent value, smallest on ties."""
    best = (value_counts(df, columns, as_text).groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("b")))
    return best.select("column", F.col("b.value").alias("mode"), (-F.col("b.neg")).alias("freq"))


def number_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, freq) of numbers counted in their own type; `mode` is text, so that no digit is lost.

    Integers share one scan as bigint, floats one as double without NaN, and each decimal type has its own.
    """
    kinds: dict[str, list[str]] = {}
    types = dict(df.dtypes)
    for c in columns:
        kind = types[c]
        whole = kind in ("tinyint", "smallint", "int", "bigint")
        kinds.setdefault("bigint" if whole else kind if kind.startswith("decimal") else "double", []).append(c)
    parts = []
    for kind, group in kinds.items():
        plain = df.select(*[(as_double(df, c) if kind == "double" else F.col(c).cast(kind)).alias(f"c{i}")
                            for i, c in enumerate(group)])
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("value")) for i in range(len(group))])
        best = (plain.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")
                .groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("b")))
        parts.append(best.select(F.get(F.array(*[F.lit(c) for c in group]), F.col("i")).alias("column"),
                                 F.col("b.value").cast("string").alias("mode"), (-F.col("b.neg")).alias("freq")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct non-null values per column."""
    rows = (value_counts(df, columns).groupBy("column")
            .agg(F.count(F.lit(1)).alias("n")).collect())
    found = {r["column"]: r["n"] for r in rows}
    return {c: found.get(c, 0) for c in columns}
