"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from grainmill.operators import anomalies, neighbors, pii, validate
from grainmill.operators.dedup import remove_duplicates
from grainmill.operators.topk import page
from grainmill.operators.windows import lag_features

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet")


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_limits_reach_the_scan(events):
    rules = {"columns": {"value": {"max": 40.0}}}
    text = plan(validate.row_violations(events, rules, ["event_id"]))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    after = page(events, ["event_id"], 1, after=[500])
    assert "GreaterThan(event_id,500)" in plan(after)


def test_no_python_in_native_operators(events, spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (pii.detect(documents, ["doc_id"], ["text"]), pii.mask(documents, ["text"]),
               anomalies.iqr_anomalies(events, ["event_id"], ["value"]),
               lag_features(events, ["value"], [1], ["user_id"], ["ts", "event_id"])):
        assert "Python" not in plan(df)


def test_keyed_windows_keep_their_key(events):
    text = plan(lag_features(events, ["value"], [1], ["user_id"], ["ts", "event_id"]))
    assert "SinglePartition" not in text and "hashpartitioning(user_id" in text


def test_duplicates_collapse_before_the_shuffle(events):
    text = plan(remove_duplicates(events, ["user_id", "event_type"], ["ts", "event_id"]))
    assert "partial_min_by" in text


def test_neighbour_search_has_no_product(spark):
    points = spark.range(3000).select(F.col("id").alias("p"), F.rand(1).alias("x"), F.rand(2).alias("y"),
                                      F.lit(1).alias("w"))
    text = plan(neighbors.nearest(points.select(F.col("p").alias("q"), "x", "y"), points, ["x", "y"], 3))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
