"""Neighbour search and what is built on it, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill.operators.isolation import isolation_scores
from grainmill.operators.neighbors import knn_impute, local_outlier_factor, nearest, smote


def cloud(d, n=220, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[: n // 3] * 1e-4 + 5  # a third of the points in a tight clump
    x[n // 3: n // 3 + 5] *= 50           # far away points
    return x.round(6)


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_nearest_is_exact(spark, d, tiny_limits):
    x = cloud(d)
    coords = [f"x{i}" for i in range(d)]
    pdf = pd.DataFrame(np.unique(x, axis=0), columns=coords)
    pdf["p"], pdf["w"] = range(len(pdf)), 1
    points = spark.createDataFrame(pdf)
    queries = points.select(F.col("p").alias("q"), *[(F.col(c) + 0.01).alias(c) for c in coords])
    got = nearest(queries, points, coords, 4).toPandas()
    v = pdf[coords].to_numpy()
    dist = np.sqrt(((v[:, None] + 0.01 - v[None]) ** 2).sum(-1))
    for q, part in got.groupby("q"):
        assert len(part) == 4
        assert np.allclose(np.sort(part["dist"]), np.sort(dist[q])[:4])


def test_weights_stand_for_copies(spark):
    pdf = pd.DataFrame({"p": [0, 1, 2], "x": [0.0, 1.0, 9.0], "w": [5, 1, 1]})
    points = spark.createDataFrame(pdf)
    got = nearest(points.select(F.col("p").alias("q"), "x"), points, ["x"], 4).toPandas()
    assert got[got["q"] == 1].set_index("p")["w"].to_dict() == {1: 1, 0: 3}


def brute_lof(x, k):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.array([np.lexsort((np.arange(n), d[i]))[:k] for i in range(n)])
    kd = np.array([d[i, near[i]].max() for i in range(n)])
    lrd = np.array([1 / (np.maximum(kd[near[i]], d[i, near[i]]).mean() + 1e-10) for i in range(n)])
    return np.array([lrd[near[i]].mean() / lrd[i] for i in range(n)])


def test_lof(spark):
    x = cloud(2, 150)
    pdf = pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]})
    got = local_outlier_factor(spark.createDataFrame(pdf), ["id"], ["a", "b"], 10).toPandas().sort_values("id")
    assert np.allclose(got["lof"], brute_lof(x, 10))


def test_lof_with_a_crowd_of_copies(spark):
    x = np.vstack([np.zeros((60, 2)), cloud(2, 40)])
    pdf = pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]})
    got = local_outlier_factor(spark.createDataFrame(pdf), ["id"], ["a", "b"], 10).toPandas().sort_values("id")
    assert len(got) == 100 and np.allclose(got["lof"][:60], 1.0)


def test_knn_impute_three_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)).round(2)
    x[rng.random(x.shape) < 0.25] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["id"] = range(len(pdf))
    got = knn_impute(spark.createDataFrame(pdf), list("abc"), ["id"], 3).toPandas().sort_values("id")
    want = x.copy()
    for i in range(len(x)):
        for c in range(3):
            if not np.isnan(x[i, c]):
                continue
            found = []
            for j in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, c]) and both.any():
                    found.append((np.sqrt(3 / both.sum() * ((x[i, both] - x[j, both]) ** 2).sum()), j))
            found.sort(key=lambda t: (round(t[0], 9), t[1]))
            want[i, c] = np.mean([x[j, c] for _, j in found[:3]]) if found else np.nanmean(x[:, c])
    assert np.allclose(got[list("abc")], want)


def test_planted_outlier_is_most_isolated(spark):
    x = np.vstack([np.random.default_rng(0).normal(size=(300, 2)), [[9.0, 9.0]]])
    pdf = pd.DataFrame({"id": range(301), "a": x[:, 0], "b": x[:, 1]})
    got = isolation_scores(spark.createDataFrame(pdf), ["id"], ["a", "b"]).toPandas()
    assert got["score"].between(0, 1, inclusive="neither").all()
    assert got.loc[got["score"].idxmax(), "id"] == 300


def test_smote_levels_the_classes(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(50), "x0": rng.normal(size=50), "x1": rng.normal(size=50),
                        "y": [0] * 45 + [1] * 5})
    got = smote(spark.createDataFrame(pdf), "y", ["x0", "x1"], ["id"]).toPandas()
    assert got.groupby("y").size().to_dict() == {0: 45, 1: 45}
    small = pdf[pdf["y"] == 1]
    made = got[got["synthetic"]]
    assert made["x0"].between(small["x0"].min(), small["x0"].max()).all()
