import pytest
from grainmill.operators import topk, timeseries
from grainmill.sources import exporters, readers


def test_page_honours_its_size(spark):
    df = spark.range(5000)
    assert topk.page(df, ["id"], 1, 2000).count() == 2000
    with pytest.raises(ValueError):
        topk.page(df, ["id"], 0, 10)


def test_infinity_is_null_in_sql(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, 1.5)], "id long, v double")
    text = "\n".join(str(r) for r in exporters.insert_statements(df, "t", ["id"]).collect())
    assert "NULL" in text and "Infinity" not in text and "1.5" in text


def test_xml_with_comment_and_late_record(spark, tmp_path):
    body = "<?xml version='1.0'?>\n<!-- <no><tag> -->\n" + "<!-- x -->\n" * 80
    (tmp_path / "a.xml").write_text(body + "<root>\n" + "<!-- y -->\n" * 80 + "<rec><a>1</a></rec><rec><a>2</a></rec></root>")
    assert readers.read_xml(spark, str(tmp_path / "a.xml")).count() == 2
    with pytest.raises(ValueError):
        readers.read_xml(spark, str(tmp_path / "a.xml"), "absent")


def test_changepoints_go_on_until_nothing_splits(spark):
    rows = [(k, 100.0 * 3 ** (k // 4)) for k in range(40)]
    df = spark.createDataFrame(rows, "t long, v double")
    found = timeseries.changepoints(df, "v", [], ["t"], penalty=1.0)
    assert {r.position for r in found.collect()} == {k + 1 for k in range(4, 40, 4)}
