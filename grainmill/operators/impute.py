"""Missing-value imputation: mean, median, mode, fills, constants, neighbours, auto plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import fill_ordered
from .profile import missing, nan_to_null, numeric_columns, one_pass, require_columns, text_columns
from .quantiles import exact_quantiles, modes, number_modes

STRATEGIES = ("mean", "median", "mode", "ffill", "bfill", "knn", "auto")
# Missing shares that decide the automatic strategy, and the neighbour count.
NUMERIC_MEDIAN_ABOVE = 0.4
NUMERIC_KNN_ABOVE = 0.1
TEXT_MODE_ABOVE = 0.2
NEIGHBORS = 3


def imputation_plan(df: DataFrame, strategy: str = "auto") -> DataFrame:
    """(column, ratio, strategy), decided in one pre-aggregated scan."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    ratios = one_pass(df, {c: {"ratio": F.try_divide(F.count_if(missing(df, c)),
                                                     F.count(F.lit(1)))} for c in df.columns})
    numbers = [f.name for f in df.schema
               if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    ratio = F.coalesce("ratio", F.lit(0.0))
    if strategy == "auto":
        choice = (F.when(F.col("column").isin(*numbers),
                         F.when(ratio > NUMERIC_MEDIAN_ABOVE, "median")
                         .when(ratio > NUMERIC_KNN_ABOVE, "knn").otherwise("mean"))
                  .when(F.col("column").isin(*text_columns(df)),
                        F.when(ratio > TEXT_MODE_ABOVE, "mode").otherwise("ffill"))
                  .otherwise("mode"))
    else:
        choice = F.lit(strategy)
    return ratios.select("column", ratio.alias("ratio"),
                         F.when(ratio == 0, "none").otherwise(choice).alias("strategy"))


def fill_values(df: DataFrame, plan: Mapping[str, str]) -> dict[str, object]:
    """One fill value per column planned as mean, median or mode."""
    means = [c for c, s in plan.items() if s == "mean"]
    medians = [c for c, s in plan.items() if s == "median"]
    values: dict[str, object] = {}
    clean = nan_to_null(df)
    if means:
        values.update(clean.agg(*[F.avg(c).alias(c) for c in means]).first().asDict())
    if medians:
        values.update({c: v[0] for c, v in exact_quantiles(df, medians, [0.5]).items()})
    moded = [c for c, s in plan.items() if s == "mode"]
    kinds = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, T.NumericType)}
    numbers, others = [c for c in moded if c in kinds], [c for c in moded if c not in kinds]
    for r in number_modes(clean, numbers).collect() if numbers else ():
        kind = kinds[r["column"]]
        made = Decimal if isinstance(kind, T.DecimalType) else int if isinstance(kind, T.IntegralType) else float
        values[r["column"]] = made(r["mode"])
    for r in modes(clean, others).collect() if others else ():
        values[r["column"]] = r["mode"]
    return values


def apply_fill_values(df: DataFrame, values: Mapping[str, object],
                      default: str | None = None) -> DataFrame:
    """Replace missing values by literals; a pure row expression (also on streams)."""
    kinds = dict(df.dtypes)
    out = {}
    for c, v in values.items():
        if v is None and default is None:
            continue
        fill = F.lit(default if v is None else v)
        kind = kinds[c]
        if kind in ("double", "float"):
            out[c] = F.when(~missing(df, c), F.col(c)).otherwise(fill.cast(kind))
        elif isinstance(v, float):  # integer column filled by a mean: the column turns double
            whole = kind in ("tinyint", "smallint", "int", "bigint") and v.is_integer()
            out[c] = F.coalesce(F.col(c).cast(kind if whole else "double"),
                                fill.cast(kind if whole else "double"))
        else:
            out[c] = F.coalesce(F.col(c), fill.cast(kind))
    return df.withColumns(out) if out else df


class Imputer:
    """fit learns the plan and the fill values; transform applies them.

    `order_by` (and optional `keys`) are needed when a column is planned ffill, bfill or
    knn, since those refer to other rows.
    """

    def __init__(self, strategy: str = "auto", neighbors: int = NEIGHBORS,
                 order_by: Sequence[str] = (), keys: Sequence[str] = ()) -> None:
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        self.strategy, self.neighbors = strategy, neighbors
        self.order_by, self.keys = list(order_by), list(keys)
        self.plan: dict[str, str] | None = None
        self.values: dict[str, object] = {}

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> Imputer:
        require_columns(df, columns or [])
        target = df.select(*columns) if columns else df
        self.plan = {r["column"]: r["strategy"]
                     for r in imputation_plan(target, self.strategy).collect()}
        self.values = fill_values(df, self.plan)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.plan is None:
            raise RuntimeError("call fit first")
        out = df
        near = [c for c, s in self.plan.items() if s == "knn"]
        if near:
            from .neighbors import knn_impute

            out = knn_impute(out, near, self.order_by, self.neighbors)
        out = apply_fill_values(out, self.values)
        for strategy, forward in (("ffill", True), ("bfill", False)):
            columns = [c for c, s in self.plan.items() if s == strategy]
            if columns:
                out = fill_ordered(nan_to_null(out), self.keys, self.order_by, columns, forward)
        return out

    def fit_transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df)


def impute_constant(df: DataFrame, value: object, columns: Sequence[str]) -> DataFrame:
    return df.fillna(value, list(columns))


def impute_default(df: DataFrame, absent: str = "MISSING") -> DataFrame:
    """Means for numbers, modes for the rest, and a fixed word for all-null text columns."""
    counts = {r["column"]: r["n"] for r in one_pass(
        df, {c: {"n": F.count_if(missing(df, c))} for c in df.columns}).collect()}
    numbers = set(numeric_columns(df))
    plan = {c: "mean" if c in numbers else "mode" for c in df.columns if counts[c]}
    values = fill_values(df, plan)
    texts = set(text_columns(df))
    return apply_fill_values(df, {c: values.get(c) if values.get(c) is not None
                                  else (absent if c in texts else None) for c in plan})
