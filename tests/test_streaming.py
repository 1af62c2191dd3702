"""Row operators run unchanged on a file stream, and a rerun picks up only new files."""

from pyspark.sql import functions as F

from grainmill.operators import pii, validate
from grainmill.streaming import run_available, stream_files


def test_masking_and_validation_on_a_stream(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "id long, note string, v double"
    first = spark.createDataFrame([(1, "write to a@b.org", 5.0), (2, "plain", 50.0)], schema)
    first.write.json(source)
    rules = {"columns": {"v": {"max": 10}}}
    steps = [lambda d: pii.mask(d, ["note"]), lambda d: d.withColumn("bad", F.col("v") > 10)]
    run_available(stream_files(spark, source, "json", schema, 1), steps, target, marks)
    got = {r["id"]: r for r in spark.read.parquet(target).collect()}
    assert got[1]["note"] == "write to [REDACTED]" and got[2]["bad"] and not got[1]["bad"]
    spark.createDataFrame([(3, "c@d.org", 1.0)], schema).write.mode("append").json(source)
    run_available(stream_files(spark, source, "json", schema, 1), steps, target, marks)
    assert spark.read.parquet(target).count() == 3
    checked = validate.row_violations(stream_files(spark, source, "json", schema), rules, ["id"])
    run_available(checked, [], str(tmp_path / "bad"), str(tmp_path / "marks2"))
    assert spark.read.parquet(str(tmp_path / "bad")).select("row_id").collect()[0][0] == "2"
