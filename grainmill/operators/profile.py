"""Profiling: shape, missing values, descriptive statistics, distributions."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import as_double, exact_quantiles, modes, number_modes, value_counts

COLUMNS_PER_PASS = 100  # keeps one aggregate inside code-generation limits
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in float columns becomes NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def missing(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    test = F.col(c).isNull()
    return test | F.isnan(c) if kind in ("double", "float") else test


def one_pass(df: DataFrame, metrics: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over many columns, returned as one row per column.

    `metrics` maps a column to {metric name: aggregate}; all columns share the names.
    """
    parts = []
    columns = list(metrics)
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        group = columns[start:start + COLUMNS_PER_PASS]
        aggregates = [expr.alias(f"{i}_{m}") for i, c in enumerate(group)
                      for m, expr in metrics[c].items()]
        wide = df.agg(*aggregates)
        rows = F.array(*[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{m}").alias(m) for m in metrics[c]])
            for i, c in enumerate(group)])
        parts.append(wide.select(F.explode(rows).alias("r")).select("r.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def shape(df: DataFrame) -> DataFrame:
    """(column, type, position, n_rows)."""
    fields = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"),
                                F.lit(i).alias("position"))
                       for i, (c, t) in enumerate(df.dtypes)])
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.explode(fields).alias("f"), "n_rows").select("f.*", "n_rows"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, n_missing, n_rows)."""
    return one_pass(df, {c: {"n_missing": F.count_if(missing(df, c)),
                             "n_rows": F.count(F.lit(1))} for c in df.columns})


def _literal_table(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), schema)


def bias_corrected_skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def bias_corrected_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
                  * ((n + 1) * F.kurtosis(c) + 6))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, median, mode, variance, std, skewness, kurtosis: one row per numeric column."""
    columns = list(columns or numeric_columns(df))
    require_columns(df, columns)
    if not columns:
        return _literal_table(df, [], "column string, n bigint, mean double, variance double, std double, "
                                      "skewness double, kurtosis double, median double, mode double")
    moments = one_pass(df, {c: {
        "n": F.count(as_double(df, c)),
        "mean": F.avg(as_double(df, c)),
        "variance": F.var_samp(as_double(df, c)),
        "std": F.stddev_samp(as_double(df, c)),
        "skewness": bias_corrected_skew(as_double(df, c)),
        "kurtosis": bias_corrected_kurtosis(as_double(df, c)),
    } for c in columns})
    medians = exact_quantiles(df, columns, [0.5])
    median = F.create_map(*[x for c in columns
                            for x in (F.lit(c), F.lit(medians[c][0]).cast("double"))])
    return (moments.withColumn("median", median[F.col("column")])
                   .join(number_modes(df, columns).select(
                       "column", F.col("mode").cast("double").alias("mode")), "column", "left"))


def datetime_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, median and mode of timestamps, as text to the second."""
    columns = list(columns or datetime_columns(df))
    if not columns:
        return _literal_table(df, [], "column string, mean string, median string, mode string")
    medians = exact_quantiles(df, columns, [0.5])
    mean = one_pass(df, {c: {"mean": F.avg(as_double(df, c))} for c in columns})
    median = F.create_map(*[x for c in columns
                            for x in (F.lit(c), F.lit(medians[c][0]).cast("double"))])

    def text(c: str) -> Column:
        return F.date_format(F.timestamp_micros(F.col(c).cast("bigint")), "yyyy-MM-dd HH:mm:ss")

    joined = (mean.withColumn("median", median[F.col("column")])
                  .join(modes(df, columns, as_text=False), "column", "left"))
    return joined.select("column", text("mean").alias("mean"), text("median").alias("median"),
                         text("mode").alias("mode"))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mode, its frequency and the number of distinct values per text column."""
    columns = list(columns or text_columns(df))
    if not columns:
        return _literal_table(df, [], "column string, mode string, freq bigint, n_distinct bigint")
    best = (value_counts(df, columns).groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("b"),
                 F.count(F.lit(1)).alias("n_distinct")))
    return best.select("column", F.col("b.value").alias("mode"),
                       (-F.col("b.neg")).alias("freq"), "n_distinct")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, lower, upper, n): equal widths, last bin closed on the right, empty bins kept."""
    v = as_double(df, column)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        return _literal_table(df, [], "bin int, lower double, upper double, n bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    counts = (df.select(F.least(F.floor((v - lo) / width), F.lit(bins - 1)).alias("bin"))
                .filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    frame = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * width).alias("lower"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("upper"))
    return frame.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])


def quantile_table(df: DataFrame, columns: Sequence[str] | None = None,
                   probs: Sequence[float] = QUARTILES, exact: bool = True) -> DataFrame:
    """(column, q, value) with linear interpolation; `exact=False` uses sketches in one pass."""
    columns = list(columns or numeric_columns(df))
    probs = list(probs)
    if not exact:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        wide = one_pass(df, {c: {"v": F.percentile_approx(as_double(df, c), levels, F.lit(10000))}
                             for c in columns})
        return wide.select("column", F.explode(F.arrays_zip(levels.alias("q"), F.col("v").alias("value"))).alias("z")
                           ).select("column", F.col("z.q").alias("q"), F.col("z.value").alias("value"))
    found = exact_quantiles(df, columns, probs)
    rows = [(c, float(p), found[c][i]) for c in columns for i, p in enumerate(probs)]
    return _literal_table(df, rows, "column string, q double, value double")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values, nulls dropped, ties by value."""
    require_columns(df, [column])
    return (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
              .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k))


def histograms(df: DataFrame, ends: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """(column, bin, lower, upper, n): `histogram` of many columns in one scan, given their smallest and largest."""
    lows, widths = {}, {}
    for c, (lo, hi) in ends.items():
        lows[c] = lo - 0.5 if lo == hi else lo
        widths[c] = (1.0 if lo == hi else hi - lo) / bins
    # `least` passes over nulls, so they are kept out of it.
    hits = F.array(*[F.struct(F.lit(c).alias("column"), F.when(as_double(df, c).isNotNull(), F.least(
        F.floor((as_double(df, c) - lows[c]) / widths[c]), F.lit(bins - 1))).cast("int").alias("bin")) for c in ends])
    counts = (df.select(F.explode(hits).alias("h")).select("h.*").filter("bin is not null")
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")))
    frame = _literal_table(df, [(c, i, lows[c] + i * widths[c], lows[c] + (i + 1) * widths[c])
                                for c in ends for i in range(bins)],
                           "column string, bin int, lower double, upper double")
    return frame.join(counts, ["column", "bin"], "left").fillna(0, ["n"])


def top_counts(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column, place, value, n): the most frequent values of each column as text, ties by that text.

    The rank filter keeps `k` rows of every task before the shuffle by column.
    """
    counts = value_counts(df, columns)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
            .select("column", "place", "value", "n"))


def full_profile(df: DataFrame, bins: int = 10, k: int = 10) -> DataFrame:
    """(column, metric, value): every statistic of every column in long form.

    Histograms are the metrics bin_1, lower_1, upper_1 and so on, frequent values top_1 and top_n_1 and so on.
    """
    def melt(wide: DataFrame) -> DataFrame:
        metrics = [c for c in wide.columns if c != "column"]
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
                          for m in metrics])
        return wide.select("column", F.explode(pairs).alias("p")).select("column", "p.*")

    def numbered(rows: DataFrame, place: Column, names: dict[str, str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.concat(F.lit(m), place.cast("string")).alias("metric"),
                                   F.col(c).cast("string").alias("value")) for c, m in names.items()])
        return rows.select("column", F.explode(pairs).alias("p")).select("column", "p.*")

    if not df.columns:
        return _literal_table(df, [], "column string, metric string, value string")
    numbers, texts, dates, flags = numeric_columns(df), text_columns(df), datetime_columns(df), boolean_columns(df)
    parts = [melt(missing_counts(df))]
    if numbers:
        parts.append(melt(numeric_profile(df, numbers).drop("n")))
        found = exact_quantiles(df, numbers, QUARTILES)
        rows = [(c, *found[c]) for c in numbers]
        parts.append(melt(_literal_table(
            df, rows, "column string, min double, q25 double, q50 double, q75 double, max double")))
        ends = {c: (v[0], v[-1]) for c, v in found.items() if v[0] is not None}
        # A column that holds an infinity has the histogram of its other values.
        finite = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c)) for c, v in ends.items() if not isfinite(v[1] - v[0])}
        if finite:
            inner = one_pass(df, {c: {"lo": F.min(v).cast("double"), "hi": F.max(v).cast("double")} for c, v in finite.items()}).collect()
            ends |= {r["column"]: (r["lo"], r["hi"]) for r in inner}
            ends = {c: v for c, v in ends.items() if v[0] is not None and isfinite(v[1] - v[0])}
        if ends:
            parts.append(numbered(histograms(df.withColumns(finite), ends, bins), F.col("bin") + 1,
                                  {"n": "bin_", "lower": "lower_", "upper": "upper_"}))
    if texts or flags:
        parts.append(melt(categorical_profile(df, [*texts, *flags])))
    if flags:
        parts.append(melt(one_pass(df, {c: {"mean": F.avg(F.col(c).cast("int"))} for c in flags})))
    if dates:
        parts.append(melt(datetime_profile(df, dates)))
    counted = [*numbers, *texts, *flags, *dates]
    if counted:
        parts.append(numbered(top_counts(nan_to_null(df), counted, k), F.col("place"), {"value": "top_", "n": "top_n_"}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def profile_json(profile: DataFrame) -> DataFrame:
    """One JSON object per column from a long profile."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    return profile.groupBy("column").agg(F.to_json(entries).alias("json"))


def describe_all(df: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of numbers and dates; unique, top, freq of text and booleans.

    Dates and timestamps have their statistics in microseconds since 1970.
    """
    numbers = [*numeric_columns(df), *datetime_columns(df)]
    texts = [*text_columns(df), *boolean_columns(df)]
    names = ("min", "q25", "q50", "q75", "max")
    if not numbers and not texts:
        return _literal_table(df, [], "column string, count bigint, mean double, std double")
    stats = one_pass(df, {c: {
        "count": F.count(F.col(c) if c in texts else as_double(df, c)),
        "mean": (F.avg(as_double(df, c)) if c in numbers else F.lit(None).cast("double")),
        "std": (F.stddev_samp(as_double(df, c)) if c in numbers else F.lit(None).cast("double")),
    } for c in [*numbers, *texts]})
    found = exact_quantiles(df, numbers, QUARTILES)
    if numbers:
        spread = _literal_table(df, [(c, *found[c]) for c in numbers],
                                "column string, " + ", ".join(f"{n} double" for n in names))
        stats = stats.join(F.broadcast(spread), "column", "left")
    if texts:
        top = categorical_profile(df, texts).select(
            "column", F.col("n_distinct").alias("unique"), F.col("mode").alias("top"), "freq")
        stats = stats.join(top, "column", "left")
    return stats


def approx_distinct(df: DataFrame, columns: Sequence[str] | None = None,
                    rsd: float = 0.05) -> DataFrame:
    columns = list(columns or df.columns)
    return one_pass(df, {c: {"n_distinct": F.approx_count_distinct(c, rsd)} for c in columns})
