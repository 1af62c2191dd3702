"""Exact Shapley values of forests and boosted trees, with features left out by the share of rows down each branch.

A tree is the sum of its leaves. A leaf's value reaches a row through the conditions on its path, one for each feature
there: a known feature lets the row through or not (o = 1 or 0), one left out lets through the share z of the training
rows. Averaged over all orders, feature i of the path is worth

    value * (o_i - z_i) * integral from 0 to 1 of the product over the others of (o_j t + z_j (1 - t)) dt,

a polynomial in t that a few Gauss-Legendre points integrate exactly. So the cost is leaves times features of a path,
not orders or subsets. Rows are scored in Arrow batches; the paths of the model go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import require_columns
from .models import TrendPredictor

Path = tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # value, feature, above, up to, share


def leaf_paths(predictor: TrendPredictor) -> list[Path]:
    """Every leaf of every tree as its value and, for each feature on the way, its bounds and share of rows."""
    model = predictor.model
    if predictor.model_type not in ("rf", "gb") or not hasattr(model, "trees"):
        raise ValueError("a forest or boosted trees for one target are needed")
    boosted = predictor.model_type == "gb"
    weights = list(model.treeWeights) if boosted else [1.0 / len(model.trees)] * len(model.trees)
    votes = predictor.task == "classification" and not boosted
    out: list[Path] = []
    for tree, weight in zip(model.trees, weights):
        work = [(tree._java_obj.rootNode(), {})]
        while work:
            node, met = work.pop()
            if node.subtreeDepth() == 0:
                value = float(node.prediction())
                if votes:
                    stats = list(node.impurityStats().stats())
                    value = stats[1] / sum(stats)
                features = sorted(met)
                out.append((weight * value, np.array(features, int), *(np.array([met[f][k] for f in features], float) for k in range(3))))
                continue
            split, rows = node.split(), float(node.impurityStats().count())
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("splits by category are not supported")
            feature, limit = split.featureIndex(), float(split.threshold())
            for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
                above, up_to, share = met.get(feature, (-np.inf, np.inf, 1.0))
                bounds = (above, min(up_to, limit)) if left else (max(above, limit), up_to)
                work.append((child, met | {feature: (*bounds, share * float(child.impurityStats().count()) / rows)}))
    return out


def contributions(x: np.ndarray, paths: Sequence[Path]) -> np.ndarray:
    """(rows, features): exact Shapley values of the sum of all leaves."""
    out = np.zeros(x.shape)
    points = {}
    for value, feature, above, up_to, share in paths:
        if not len(feature) or not value:
            continue
        if len(feature) not in points:
            t, w = np.polynomial.legendre.leggauss((len(feature) + 1) // 2)
            points[len(feature)] = ((t + 1) / 2, w / 2)
        through = (x[:, feature] > above) & (x[:, feature] <= up_to)
        total = np.zeros(through.shape)
        for t, w in zip(*points[len(feature)]):
            factor = np.where(through, t, 0.0) + share * (1 - t)
            total += w * factor.prod(axis=1, keepdims=True) / factor
        np.add.at(out.T, feature, (value * (through - share) * total).T)
    return out


def tree_shapley(df: DataFrame, row_id: Sequence[str], predictor: TrendPredictor) -> DataFrame:
    """(row_id, feature, contribution, base_value): they add up to the probability of class 1 (forest), the margin
    (boosted trees, two classes) or the prediction (regression). Missing features are filled as in `predict`."""
    require_columns(df, [*row_id, *predictor.selected])
    paths = leaf_paths(predictor)
    base = float(sum(value * share.prod() for value, _, _, _, share in paths))
    names = predictor.selected
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float(predictor.means.get(c, 0.0)))) for c in names])
    rows = df.select(*row_id, values.alias("__x"))
    sent = df.sparkSession.sparkContext.broadcast(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1)
            made = contributions(x, sent.value)
            lists = pa.ListArray.from_arrays(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], batch.schema.names)

    made = rows.mapInArrow(run, rows.schema)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.get("__x", F.lit(j)).alias("contribution")) for j, c in enumerate(names)])
    return made.select(*row_id, F.explode(parts).alias("p")).select(*row_id, "p.*", F.lit(base).alias("base_value"))
