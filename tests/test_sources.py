"""File heads, mixed folders and encodings."""

import time
from io import BytesIO

import pytest

from grainmill.sources import batch_ingest, file_catalog, heads, read_csv, read_json, readers


def names(rows, column):
    return {r["file"].rsplit("/", 1)[-1]: r[column] for r in rows}


def test_large_files_are_typed_by_content(spark, tmp_path):
    (tmp_path / "big.json").write_text("a,b\n" + "1,2\n" * 2_300_000)  # 9 MB of CSV under another name
    (tmp_path / "small.csv").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "empty.csv").write_text("")
    got = file_catalog(spark, str(tmp_path)).collect()
    assert names(got, "type") == {"big.json": "csv", "small.csv": "json", "empty.csv": "unknown"}
    assert names(got, "shape") == {"big.json": "a,b", "small.csv": "lines", "empty.csv": None}


def test_shapes():
    shape = lambda b: heads.json_shape(BytesIO(b))
    assert shape(b'\xef\xbb\xbf\n {"a": 1}\n\n{"a": 2}\n') == "lines"
    assert shape(b'{"a": 1}\n') == shape(b'{\n"a":\n {"b": []}}') == shape(b"{}") == "object"
    assert shape(b'{"a": [{"x": 1}],\n "b": []}') == "lists"
    assert shape(b'{"a": [1, 2]}') == "object"
    assert shape(b'\n [\n {"a": 1}]') == "list"
    with pytest.raises(ValueError):
        shape(b'{"a": [')


def test_folder_of_json_shapes(spark, tmp_path):
    files = {"lines.json": '{"a": 1}\n{"a": 2}\n', "list.json": '[{"a": 3, "x": "s"}]', "lists.json": '{"l": [{"a": 4}], "m": [{"a": 5}]}',
             "object.json": '{"a": 6, "o": {"p": 1}}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    df = read_json(spark, str(tmp_path))
    assert sorted(r["a"] for r in df.collect()) == [1, 2, 3, 4, 5, 6]
    assert set(df.columns) == {"a", "x", "o.p"}


def jobs(spark, run):
    group = f"count-{time.time()}"
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    spark.sparkContext.setJobGroup("after", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_one_bad_file_fails_alone_and_files_cost_no_jobs(spark, tmp_path):
    def folder(name, n):
        base = tmp_path / name
        base.mkdir()
        for k in range(n):
            (base / f"{k}.json").write_text(f'{{"l": [{{"a": {k}}}, {{"a": {k}}}]}}')
            (base / f"{k}.csv").write_text(f"u,v\n{k},1\n{k},2\n{k},3\n")
        (base / "bad.json").write_text('[{"a": 1}, {"a": ')
        (base / "bad.parquet").write_bytes(b"PAR1nothing")
        (base / "bad.xml").write_text("<r><!-- only a comment")
        (base / "lines.json").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
        return str(base)

    (frames, report), few = jobs(spark, lambda p=folder("few", 2): batch_ingest(spark, p))
    (more, _), many = jobs(spark, lambda p=folder("many", 12): batch_ingest(spark, p))
    status = {r["file"].rsplit("/", 1)[-1]: (r["status"], r["rows"]) for r in report.collect()}
    assert status == {"0.json": ("ok", 2), "1.json": ("ok", 2), "0.csv": ("ok", 3), "1.csv": ("ok", 3), "bad.json": ("failed", None),
                      "bad.parquet": ("failed", None), "bad.xml": ("failed", None), "lines.json": ("ok", 2)}
    assert frames["json"].count() == 6 and more["csv"].count() == 36 and many == few


def test_files_only_spark_can_open(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('[{"a": 1}]')
    files = [r["path"] for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()]
    got = heads.through_spark(spark, files).collect()
    assert [(r["sniffed"], r["shape"], r["error"]) for r in got] == [("json", "list", None)]
    assert heads.look("nosuch://x/y")["error"].startswith(heads.UNREACHABLE)


def test_encodings_in_one_scan(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("naïve,n\ncafé,1\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("﻿naïve,n\ncafé € \U0001F600,2\nplain,3\n".encode())
    latin, utf = read_csv(spark, str(tmp_path / "latin.csv")), read_csv(spark, str(tmp_path / "utf.csv"))
    assert latin.columns == utf.columns == ["naïve", "n"]
    assert latin.first()["naïve"] == "café"
    assert [r["naïve"] for r in utf.orderBy("n").collect()] == ["café € \U0001F600", "plain"]
    both = read_csv(spark, str(tmp_path), "name string, n int")
    assert sorted(r["name"] for r in both.collect()) == ["café", "café € \U0001F600", "plain"]
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_record_tag_is_found_in_linear_time():
    def seconds(n):
        text = ["<?xml version='1.0'?>\n", *["<!-- <a> comment -->\n"] * n, "<root>\n", *["<!-- x -->\n"] * n, "<rec><a/></rec></root>"]
        start = time.time()
        assert heads.record_tag(t.encode() for t in text) == "rec"
        return time.time() - start

    assert seconds(100_000) < 2
    with pytest.raises(ValueError):
        heads.record_tag([b"<root></root>"])
    with pytest.raises(ValueError):
        heads.record_tag([b"<root><rec"])
    assert readers.FORMATS
