"""Least squares for many groups at once: cross products are aggregated, tiny systems solved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE = "__one"


def fit_groups(rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str],
               weight: str | None = None, ridge: float = 0.0) -> DataFrame:
    """(keys, n, beta, stderr, rss): beta[0] is the intercept. One row per group.

    Only (features + 1)^2 sums per group are shuffled; the solver sees one row per group.
    """
    names = [ONE, *features]
    k = len(names)
    data = rows.withColumn(ONE, F.lit(1.0))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    value = [F.col(c).cast("double") for c in names]
    y = F.col(target).cast("double")
    sums = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w * y * y).alias("yy"),
        F.array(*[F.sum(w * value[i] * value[j]) for i in range(k) for j in range(k)]).alias("xx"),
        F.array(*[F.sum(w * v * y) for v in value]).alias("xy"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        penalty = np.diag([0.0] + [ridge] * (k - 1))
        for pdf in batches:
            out: dict[str, list] = {"beta": [], "stderr": [], "rss": []}
            for n, yy, xx, xy in zip(pdf["n"], pdf["yy"], pdf["xx"], pdf["xy"]):
                try:
                    a = np.array(xx, float).reshape(k, k) + penalty
                    b = np.array(xy, float)
                    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))  # keeps wide value ranges solvable
                    inverse = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-12) / np.outer(scale, scale)
                    beta = inverse @ b
                    rss = max(float(yy - beta @ b), 0.0)
                    spread = rss / (n - k) if n > k else np.nan
                    out["beta"].append(beta.tolist())
                    out["stderr"].append(np.sqrt(np.maximum(spread * np.diag(inverse), 0.0)).tolist())
                    out["rss"].append(rss)
                except (np.linalg.LinAlgError, TypeError, ValueError):
                    for column in out.values():
                        column.append(None)
            yield pdf[[*keys, "n"]].assign(**out)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "n bigint",
                        "beta array<double>, stderr array<double>, rss double"])
    return sums.mapInPandas(solve, schema)
