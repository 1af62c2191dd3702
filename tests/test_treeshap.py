"""Exact Shapley values of trees against the sum over all subsets; labels of any kind."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest

from grainmill.ml import treeshap
from grainmill.ml.models import TrendPredictor


def frame(n=160, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] > 0).astype(int)
    return pd.DataFrame(x, columns=list("abcd")).assign(id=range(n), y=y, z=x[:, 0] ** 2 + x[:, 1])


def expected(paths, row, known):
    """Output with the features outside `known` left out."""
    total = 0.0
    for value, feature, above, up_to, share in paths:
        part = value
        for f, lo, hi, s in zip(feature, above, up_to, share):
            part *= float(lo < row[f] <= hi) if f in known else s
        total += part
    return total


def enumerated(paths, row, d=4):
    out = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            for known in combinations(others, size):
                weight = factorial(size) * factorial(d - size - 1) / factorial(d)
                out[i] += weight * (expected(paths, row, {*known, i}) - expected(paths, row, set(known)))
    return out


@pytest.mark.parametrize("kind,task,label", [("rf", "classification", "y"), ("gb", "regression", "z"), ("rf", "regression", "z")])
def test_equals_all_subsets(spark, kind, task, label):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    params = {"numTrees": 4, "maxDepth": 4} if kind == "rf" else {"maxIter": 4, "maxDepth": 3}
    model = TrendPredictor(kind, task).fit(df, list("abcd"), label, params)
    paths = treeshap.leaf_paths(model)
    got = treeshap.tree_shapley(df, ["id"], model).toPandas()
    wide = got.pivot(index="id", columns="feature", values="contribution")[list("abcd")].to_numpy()
    x = pdf[list("abcd")].to_numpy()
    for k in range(0, len(x), 16):
        assert np.allclose(wide[k], enumerated(paths, x[k]))
    scored = model.predict(df).toPandas().sort_values("id")
    output = scored["score"] if task == "classification" else scored["prediction"]
    assert np.allclose(wide.sum(axis=1) + got["base_value"].iloc[0], output)


def test_gaps_are_filled_and_nets_refused(spark):
    pdf = frame(60)
    pdf.loc[::5, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    model = TrendPredictor("rf").fit(df, list("ab"), "y", {"numTrees": 2})
    assert treeshap.tree_shapley(df, ["id"], model).filter("contribution is null or isnan(contribution)").count() == 0
    with pytest.raises(ValueError):
        treeshap.leaf_paths(TrendPredictor("nn").fit(df, list("cd"), "y", {"maxIter": 2}))


def three(n=150):
    rng = np.random.default_rng(8)
    name = np.array(["low", "mid", "top"])[np.arange(n) % 3]
    x = np.array([{"low": -3.0, "mid": 0.0, "top": 3.0}[v] for v in name]) + rng.normal(size=n) * 0.3
    return pd.DataFrame({"id": range(n), "x": x, "u": rng.normal(size=n), "label": name, "number": [{"low": 5, "mid": 6, "top": 7}[v] for v in name]})


@pytest.mark.parametrize("kind", ["rf", "gb", "nn"])
def test_text_and_spread_labels(spark, kind):
    df = spark.createDataFrame(three())
    for label, weights in (("label", None), ("number", "balanced" if kind != "nn" else None)):
        model = TrendPredictor(kind, class_weight=weights).fit(df, ["x", "u"], label, {"maxIter": 60} if kind == "nn" else {"maxDepth": 3})
        out = model.predict(df)
        assert out.filter(f"prediction = {label}").count() >= 145
        assert dict(out.dtypes)["prediction"] == ("string" if label == "label" else "double")
        metrics = {r["metric"]: r["value"] for r in model.evaluate(df, label).collect()}
        assert metrics["accuracy"] > 0.95


def test_weights_and_grid_count(spark):
    pdf = frame(120).assign(w=lambda p: np.where(p["y"] == 1, "yes", "no"))
    pdf = pd.concat([pdf[pdf["w"] == "no"], pdf[pdf["w"] == "yes"].head(6)])
    df = spark.createDataFrame(pdf)
    share = lambda weights: TrendPredictor("rf", class_weight=weights).fit(df, ["d"], "w", {"maxDepth": 2, "numTrees": 5}).predict(
        df).filter("prediction = 'yes'").count()
    assert share(None) == 0 < share({"yes": 1000.0})
    with pytest.raises(ValueError):
        TrendPredictor("nn", class_weight="balanced")
    net = TrendPredictor("nn").fit(df, ["a", "b"], "w", grid={"maxIter": [1, 40]}, folds=2)
    assert net.best_params["maxIter"] in (1, 40) and len(net.search_scores) == 2
