"""Models, metrics and forecasts on generated fixtures (noise from a hash of the row number)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill.ml import evaluate, explain, forecast, models
from grainmill.ml.least_squares import fit_groups
from grainmill.operators import timeseries


def noise(i, salt):
    return (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(2001)) - 1000) / 1000.0


@pytest.fixture(scope="module")
def regression(spark):
    df = spark.range(100).select("id", *[noise(F.col("id"), k).alias(f"x{k}") for k in range(3)])
    return df.withColumn("y", 1.5 * F.col("x0") - 2 * F.col("x1") + 0.5 * F.col("x2") + 0.1 * noise(F.col("id"), 9)).cache()


def test_linear_regression_and_contributions(spark, regression):
    features = ["x0", "x1", "x2"]
    model = models.linear_regression(regression, features, "y")
    assert np.allclose(model.coefficients, [1.5, -2.0, 0.5], atol=0.05)
    parts = explain.linear_contributions(regression, ["id"], features, [float(c) for c in model.coefficients],
                                         float(model.intercept))
    total = parts.groupBy("id").agg((F.sum("contribution") + F.first("base_value")).alias("p"))
    made = model.transform(models.assemble(regression, features)).select("id", "prediction").join(total, "id")
    assert made.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9


def test_sampled_shapley_of_an_additive_model(spark, regression):
    predict = lambda d: d.withColumn("output", F.col("x0") * 3 - F.col("x1"))
    got = explain.sampled_shapley(regression, ["id"], ["x0", "x1", "x2"], predict, permutations=4)
    assert got.filter("feature = 'x2'").agg(F.max(F.abs("contribution"))).first()[0] < 1e-12
    assert got.count() == 300


def test_local_surrogate_of_a_linear_model(spark, regression):
    predict = lambda d: d.withColumn("output", F.col("x0") * 3 - F.col("x1"))
    got = explain.local_surrogate(regression, ["id"], ["x0", "x1"], predict)
    sd = regression.agg(F.stddev_pop("x0")).first()[0]
    weights = got.filter("feature = 'x0'").toPandas()["weight"]
    assert np.allclose(weights, 3 * sd, rtol=1e-3)


def test_classifier_handles_nulls_weights_and_selection(spark):
    df = spark.range(200).select(
        "id", noise(F.col("id"), 1).alias("x0"), F.when(F.col("id") % 9 != 0, noise(F.col("id"), 2)).alias("x1"),
        F.lit(1.0).alias("flat"))
    df = df.withColumn("y", F.when(F.col("id") % 50 != 7, (F.col("x0") > 0.8).cast("int")))
    model = models.TrendPredictor("rf", class_weight="balanced").fit(
        df, ["x0", "x1", "flat"], "y", {"numTrees": 10}, feature_selection=True)
    assert "flat" not in model.selected
    scores = {r["metric"]: r["value"] for r in model.evaluate(df, "y").collect()}
    assert scores["accuracy"] > 0.9 and 0.9 < scores["roc_auc"] <= 1.0
    assert model.predict(df).count() == 200


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1)], "y int, p int, s double")
    got = {r["metric"]: r["value"] for r in evaluate.classification_metrics(df, "y", "p", "s").collect()}
    assert got["accuracy"] == 0.75 and got["recall"] == 0.75 and got["roc_auc"] == 0.875
    assert got["precision"] == pytest.approx((1.0 * 2 + 2 / 3 * 2) / 4)
    flat = spark.createDataFrame([(5.0, 5.0), (5.0, 6.0)], "y double, p double")
    assert {r["metric"]: r["value"] for r in evaluate.regression_metrics(flat, "y", "p").collect()}["r2"] is None


def test_folds_and_holdout_sizes(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    folds = evaluate.assign_folds(df, 5, ["id"], "y").groupBy("y", "fold").count().toPandas()
    spread = folds.groupby("y")["count"].agg(["min", "max"])
    assert ((spread["max"] - spread["min"]) <= 1).all()
    test = evaluate.assign_holdout(df, 0.2, ["id"], "y").filter("split = 'test'").groupBy("y").count().toPandas()
    assert dict(zip(test["y"], test["count"])) == {0: 19, 1: 2}


def test_metric_history(spark, tmp_path):
    path = str(tmp_path / "history")
    for day, value in (("2024-01-01", 0.9), ("2024-01-02", 0.8)):
        evaluate.record_metrics(spark, path, day, day, {"accuracy": value})
    drift = [r["drift"] for r in evaluate.metric_drift(spark.read.parquet(path)).orderBy("ts").collect()]
    assert drift[0] is None and drift[1] == pytest.approx(-0.1)


def test_grouped_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": ["a"] * 30 + ["b"] * 30, "x": rng.normal(size=60), "z": rng.normal(size=60)})
    pdf["y"] = 2 + pdf["x"] * 3 - pdf["z"] + rng.normal(size=60) * 0.1
    got = fit_groups(spark.createDataFrame(pdf), ["x", "z"], "y", ["k"]).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        want, *_ = np.linalg.lstsq(np.column_stack([np.ones(30), part["x"], part["z"]]), part["y"], rcond=None)
        assert np.allclose(got.loc[k, "beta"], want)


def test_ar2_forecast_follows_the_recursion(spark):
    y = [1.0, 2.0]
    for _ in range(40):
        y.append(0.5 + 0.6 * y[-1] - 0.3 * y[-2] + 0.01 * ((len(y) * 7919) % 11 - 5))
    df = spark.createDataFrame(list(enumerate(y)), "t long, y double")
    beta = forecast.fit_ar(df, "y", [], ["t"], 2).first()["beta"]
    got = [r["forecast"] for r in forecast.forecast_ar(df, "y", [], ["t"], 5, p=2).orderBy("step").collect()]
    want = list(y)
    for _ in range(5):
        want.append(beta[0] + beta[1] * want[-1] + beta[2] * want[-2])
    assert np.allclose(got, want[-5:])


def test_integrated_and_fourier_forecasts(spark):
    df = spark.createDataFrame([(t, 5.0 + 2 * t) for t in range(30)], "t long, y double")
    got = [r["forecast"] for r in forecast.forecast_ar(df, "y", [], ["t"], 3, p=1, d=1).orderBy("step").collect()]
    assert np.allclose(got, [65.0, 67.0, 69.0])
    wave = spark.createDataFrame([(t, float(3 * np.sin(2 * np.pi * t / 12) + 0.1 * t)) for t in range(60)], "t long, y double")
    made = forecast.forecast_fourier(wave, "y", 12, [], ["t"], 12, order=1).orderBy("step").toPandas()["forecast"]
    assert np.allclose(made, [3 * np.sin(2 * np.pi * t / 12) + 0.1 * t for t in range(60, 72)])


def test_changepoints_find_both_shifts(spark):
    values = [0.0] * 40 + [10.0] * 40 + [3.0] * 40
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate(values)], "k string, t long, v double")
    found = timeseries.changepoints(df, "v", ["k"], ["t"])
    assert sorted(r["position"] for r in found.collect()) == [41, 81]


def test_periods(spark):
    for step, want in (("1 day", 7), ("1 hour", 24), ("7 days", 52), ("1 month", 12)):
        df = spark.sql(f"select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-01' + 20 * interval {step}, interval {step})) as ts")
        assert timeseries.infer_period(df, "ts").first()["period"] == want
