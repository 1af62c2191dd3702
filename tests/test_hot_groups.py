"""The split plans give what the plain windows and pandas give, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill.operators import ordered, windows
from grainmill.operators.dedup import duplicate_flags
from grainmill.operators.joins import join_groups
from grainmill.operators.quantiles import exact_quantiles
from grainmill.operators.topk import page
from grainmill.sources.exporters import insert_statements


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 900
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdef"), n))
    value = rng.normal(size=n).round(3)
    value[rng.random(n) < 0.3] = np.nan
    return pd.DataFrame({"id": rng.permutation(n), "k": key, "ts": rng.integers(0, 40, n), "v": value})


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)


def test_running_totals(spark, skewed, tiny_limits):
    got = ordered.running_totals(frame(spark, skewed), ["k"], ["ts", "id"],
                                 {"r": F.lit(1), "s": F.coalesce("v", F.lit(0.0))}).toPandas()
    want = skewed.sort_values(["k", "ts", "id"]).copy()
    want["r"] = want.groupby("k").cumcount() + 1
    want["s"] = want["v"].fillna(0).groupby(want["k"]).cumsum()
    both = got.merge(want, on="id", suffixes=("", "_w"))
    assert (both["r"] == both["r_w"]).all() and np.allclose(both["s"], both["s_w"])


def test_number_rows_without_key_and_exclusive(spark, skewed, tiny_limits):
    got = ordered.running_totals(frame(spark, skewed), [], ["ts", "id"], {"before": F.lit(1)},
                                 inclusive=False).toPandas().sort_values(["ts", "id"])
    assert got["before"].tolist() == list(range(len(skewed)))


@pytest.mark.parametrize("keys", [["k"], []])
def test_fills(spark, skewed, tiny_limits, keys):
    for forward in (True, False):
        got = ordered.fill_ordered(frame(spark, skewed), keys, ["ts", "id"], ["v"], forward).toPandas()
        want = skewed.sort_values(["ts", "id"]).copy()
        grouped = want.groupby("k")["v"] if keys else want["v"]
        want["v"] = grouped.ffill() if forward else grouped.bfill()
        both = got.merge(want, on="id", suffixes=("", "_w"))
        assert np.allclose(both["v"].astype(float), both["v_w"], equal_nan=True)


def test_lag_and_rolling(spark, skewed, tiny_limits):
    df = frame(spark, skewed)
    got = windows.rolling_features(windows.lag_features(df, ["v"], [1, 4], ["k"], ["ts", "id"]),
                                   ["v"], [3], ["k"], ["ts", "id"], ["mean", "std"]).toPandas()
    want = skewed.sort_values(["ts", "id"]).copy()
    g = want.groupby("k")["v"]
    want["l1"], want["l4"] = g.shift(1), g.shift(4)
    want["m"] = g.transform(lambda s: s.rolling(3).mean())
    want["sd"] = g.transform(lambda s: s.rolling(3).std())
    both = got.merge(want, on="id")
    for a, b in (("v_lag_1", "l1"), ("v_lag_4", "l4"), ("v_roll_3_mean", "m"), ("v_roll_3_std", "sd")):
        assert np.allclose(both[a].astype(float), both[b], equal_nan=True)


def test_duplicate_flags(spark, skewed, tiny_limits):
    for keep in ("first", "last", "none"):
        got = duplicate_flags(frame(spark, skewed), ["k", "ts"], ["id"], keep).toPandas()
        want = skewed.sort_values("id").copy()
        want["w"] = want.duplicated(["k", "ts"], keep=False if keep == "none" else keep)
        both = got.merge(want[["id", "w"]], on="id")
        assert (both["is_duplicate"] == both["w"]).all()


def test_join_groups_keeps_every_row(spark, skewed, tiny_limits):
    df = frame(spark, skewed)
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_groups(df, sizes, ["k"], size="n").toPandas()
    assert len(got) == len(skewed)
    assert (got.groupby("k")["n"].first() == skewed.groupby("k").size()).all()


def test_quantiles_by_narrowing(spark, skewed, tiny_limits):
    df = frame(spark, skewed).withColumns({"c": F.lit(3.0), "x": F.exp(F.col("v") * 40)})
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["v", "id", "c", "x"], probs)
    assert np.allclose(got["v"], skewed["v"].quantile(probs))
    assert np.allclose(got["id"], skewed["id"].quantile(probs))
    assert got["c"] == [3.0] * len(probs)
    assert np.allclose(got["x"], np.exp(skewed["v"] * 40).quantile(probs))


def test_deep_page_and_batches(spark, skewed, tiny_limits, monkeypatch):
    monkeypatch.setattr("grainmill.operators.topk.DRIVER_ROWS", 10)
    df = frame(spark, skewed)
    got = page(df, ["id"], 5, 100).toPandas()
    assert sorted(got["id"]) == list(range(400, 500))
    batches = insert_statements(df.select("id", "k"), "t", ["id"], batch_rows=100).toPandas()
    assert len(batches) == 9 and batches["sql"].str.count("\n").eq(100).all()


def test_order_is_required(spark, skewed):
    with pytest.raises(ValueError):
        ordered.number_rows(frame(spark, skewed), ["k"], [])
