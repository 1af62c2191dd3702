"""Isolation Forest (Liu, Ting and Zhou, 2008): trees grown in tasks, scored in one map pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .profile import nan_to_null, numeric_columns, require_columns

TREES, SAMPLE_ROWS, SEED, THRESHOLD = 100, 256, 42, 0.5  # fixed values
TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, left array<int>, depth array<double>"


def average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, list, list, list]:
    """Flat tree: feature (-1 at leaves), cut, index of the left child, path length at leaves."""
    feature, cut, left, depth = [-1], [0.0], [-1], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, rows, level = todo.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(usable):
            depth[node] = level + average_path(len(rows))
            continue
        f = int(rng.choice(usable))
        at = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] < at
        feature[node], cut[node], left[node] = f, at, len(feature)
        for part in (rows[below], rows[~below]):
            todo.append((len(feature), part, level + 1))
            feature.append(-1), cut.append(0.0), left.append(-1), depth.append(0.0)
    return feature, cut, left, depth


def fit_forest(df: DataFrame, row_id: Sequence[str], columns: Sequence[str], trees: int = TREES,
               sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> tuple[list, int]:
    """(trees, rows per tree). A tree sees at most `sample_rows` rows, chosen by hash."""
    values = df.select(F.struct(*row_id).alias("id"),
                       F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    # a bounded pool first, then each tree takes the smallest hashes of its own
    pool = values.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(trees * sample_rows)
    pool = cut_lineage(pool)
    size = pool.count()
    # of the hash range only about twice the wanted share is kept per tree, before any shuffle
    share = min(1.0, 2.0 * sample_rows / max(size, 1))
    bound = int(-(2 ** 63) + share * (2 ** 64 - 1)) if share < 1.0 else 2 ** 63 - 1
    drawn = (pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
                 .withColumn("rank", F.xxhash64("id", "tree", F.lit(seed)))
                 .filter(F.col("rank") <= F.lit(bound).cast("bigint")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        chosen = pdf.nsmallest(sample_rows, "rank").sort_values("rank")
        x = np.stack(chosen["x"].to_numpy())
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        grown = _grow(x, np.random.default_rng(seed * 1_000_003 + tree), limit)
        return pd.DataFrame([[tree, *grown]], columns=["tree", "feature", "cut", "left", "depth"])

    forest = drawn.groupBy("tree").applyInPandas(build, TREE_SCHEMA).orderBy("tree").collect()
    return [(r["feature"], r["cut"], r["left"], r["depth"]) for r in forest], min(sample_rows, size)


def isolation_scores(df: DataFrame, row_id: Sequence[str], columns: Sequence[str] | None = None,
                     **options: int) -> DataFrame:
    """(row_id, score) in (0, 1), higher is more isolated; rows with missing values are skipped."""
    columns = list(columns or numeric_columns(df))
    require_columns(df, [*row_id, *columns])
    clean = nan_to_null(df).dropna(subset=columns)
    trees, size = fit_forest(clean, row_id, columns, **options)
    arrays = [(np.array(f), np.array(c), np.array(n), np.array(d)) for f, c, n, d in trees]
    shared = df.sparkSession.sparkContext.broadcast(arrays)  # trees * 2 * sample_rows nodes at most
    scale = average_path(size) or 1.0
    kinds = dict(clean.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in row_id], "score double"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[[f"__x{i}" for i in range(len(columns))]].to_numpy(float)
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, cut, left, depth in shared.value:
                node = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    right = x[every, np.maximum(f, 0)] >= cut[node]
                    node = np.where(inner, left[node] + right, node)
                total += depth[node]
            mean = total / max(len(shared.value), 1)
            yield pdf[list(row_id)].assign(score=2.0 ** (-mean / scale))

    return clean.select(*row_id, *[F.col(c).cast("double").alias(f"__x{i}")
                                   for i, c in enumerate(columns)]).mapInPandas(score, schema)


def isolation_anomalies(df: DataFrame, row_id: Sequence[str], columns: Sequence[str] | None = None,
                        threshold: float = THRESHOLD, **options: int) -> DataFrame:
    """(row_id, column, score, severity) of rows whose score exceeds the threshold."""
    scores = isolation_scores(df, row_id, columns, **options)
    return scores.filter(F.col("score") > threshold).select(
        *row_id, F.lit("combined").alias("column"), "score", F.col("score").alias("severity"))
