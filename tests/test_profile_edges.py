"""Profiles of odd column sets, and values that doubles would merge."""

from decimal import Decimal

from grainmill.operators import impute, profile

BIG = 9007199254740992


def test_mode_keeps_big_integers_and_decimals_apart(spark):
    rows = [(BIG + 1, Decimal("0.10"))] * 3 + [(BIG, Decimal("0.20")), (None, None)]
    df = spark.createDataFrame(rows, "id bigint, price decimal(30,2)")
    filled = impute.apply_fill_values(df, impute.fill_values(df, {"id": "mode", "price": "mode"}))
    assert filled.filter(f"id = {BIG + 1} and price = 0.10").count() == 4


def test_empty_column_sets(spark):
    texts = spark.createDataFrame([("a",)], "t string")
    dates = spark.sql("select date'2024-01-02' as d, true as b")
    assert profile.numeric_profile(texts).count() == 0
    assert profile.datetime_profile(texts).count() == 0
    assert profile.categorical_profile(spark.range(1)).count() == 0
    assert {r["column"] for r in profile.describe_all(dates).collect()} == {"d", "b"}
    metrics = {(r["column"], r["metric"]): r["value"] for r in profile.full_profile(dates).collect()}
    assert metrics["b", "top_1"] == "true" and metrics["b", "mean"] == "1.0" and metrics["d", "top_n_1"] == "1"


def test_full_profile_of_constants_and_nulls(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "x double, y double")
    metrics = {(r["column"], r["metric"]): r["value"] for r in profile.full_profile(df).collect()}
    assert metrics["x", "lower_1"] == "4.5" and metrics["x", "bin_6"] == "2"
    assert ("y", "bin_1") not in metrics and metrics["y", "median"] is None


def test_histogram_beside_an_infinity(spark):
    from grainmill.operators.profile import full_profile
    df = spark.createDataFrame([(float(k),) for k in range(10)] + [(float("inf"),), (None,)], "v double")
    got = {r["metric"]: r["value"] for r in full_profile(df, bins=3).collect()}
    assert [got[f"bin_{k}"] for k in (1, 2, 3)] == ["3", "3", "4"]


def test_summary_without_kpis(spark):
    from grainmill.operators import kpi, profile
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    lines = kpi.insights(profile.numeric_profile(df), None, kpi.kpis(df, "retail")).filter("kind = 'summary'").collect()
    assert [r["message"] for r in lines] == [kpi.NO_KPI]
