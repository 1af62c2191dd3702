"""Small inputs with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from grainmill.functions import scalars
from grainmill.operators import anomalies, correlate, dedup, impute, kpi, pii, profile, schema, validate
from grainmill.plans.sqlsurface import check_sql, run_sql
from grainmill.plans.steps import CleaningSteps, StepError, run_cleaning
from grainmill.sources import batch_ingest, file_catalog, insert_statements, read_csv, read_json, read_xml


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([
        (1, "Ann", "ann@x.org", 30.0, "123-45-6789", 100),
        (2, "Bob", "bob@x.org", None, "987-65-4321", 200),
        (2, "Bob", "bob@x.org", None, "987-65-4321", 200),
        (3, "Cy", None, 40.0, None, 300),
        (4, "Di", "di@x.org", 50.0, "111-22-3333", 400),
        (4, "Di", "di@x.org", 50.0, "111-22-3333", 400),
    ], "id long, name string, email string, age double, ssn string, income long")


def test_profile_numeric(spark):
    df = spark.createDataFrame([(i, 10 * i, 100 * i) for i in range(1, 6)], "a long, b long, c long")
    got = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert got["a"]["mean"] == 3.0 and got["b"]["median"] == 30.0 and got["c"]["mode"] == 100.0
    assert got["a"]["variance"] == pytest.approx(2.5) and got["a"]["skewness"] == pytest.approx(0.0)
    assert got["a"]["kurtosis"] == pytest.approx(-1.2)
    assert all(r["r"] == pytest.approx(1.0) for r in correlate.pearson(df).collect())


def test_categories_and_missing(spark):
    df = spark.createDataFrame([(c,) for c in ["a", "b", "b", "c", None, "a"]], "cat string")
    got = profile.categorical_profile(df).first()
    assert (got["mode"], got["freq"], got["n_distinct"]) == ("a", 2, 3)  # a and b tie
    assert rows(profile.missing_counts(df), "column") == [("cat", 1, 6)]
    assert rows(profile.top_values(df, "cat", 2), F.desc("n"), "value") == [("a", 2), ("b", 2)]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert rows(profile.missing_counts(df), "column") == [("v", 2, 3)]
    assert impute.Imputer("mean").fit_transform(df).filter("v = 1.0").count() == 3


def test_constant_and_tiny_columns(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "k double, v double")
    got = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert got["k"]["skewness"] is None and got["v"]["kurtosis"] is None
    assert correlate.pearson(df).first()["r"] is None
    assert profile.histogram(df, "k", 2).agg(F.sum("n")).first()[0] == 2
    assert anomalies.zscore_anomalies(df.withColumn("id", F.lit(1)), ["id"], ["k"]).count() == 0


def test_pairwise_complete_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (None, 1.0), (4.0, 8.0)],
                               "a double, b double")
    assert correlate.pearson(df).first()["r"] == pytest.approx(1.0)
    assert correlate.spearman(df).first()["r"] == pytest.approx(1.0)
    assert correlate.kendall(df).first()["r"] == pytest.approx(1.0)


def test_deduplicate(raw):
    assert dedup.remove_duplicates(raw).count() == 4
    report = dedup.dedup_report(raw).first()
    assert (report["initial_rows"], report["final_rows"], report["rows_removed"]) == (6, 4, 2)
    assert dedup.remove_duplicates(raw, ["id"], keep="none").count() == 2


def test_empty_input(spark, raw):
    empty = raw.limit(0)
    assert dedup.remove_duplicates(empty).count() == 0
    assert impute.Imputer("mean").fit_transform(empty).count() == 0
    assert anomalies.iqr_flags(empty).count() == 0
    assert pii.mask(empty).count() == 0
    assert schema.detect_primary_keys(empty).count() == 0
    assert profile.numeric_profile(empty).filter("n = 0").count() == 3


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, None, 1), (None, None, 2), (3.0, None, 3)], "a double, b double, c long")
    plan = {r["column"]: r["strategy"] for r in impute.imputation_plan(df).collect()}
    assert plan == {"a": "knn", "b": "median", "c": "none"}
    assert rows(impute.Imputer("mean").fit_transform(df, ["a"]), "c")[1][0] == 2.0
    assert impute.Imputer("median").fit_transform(df, ["b"]).filter("b is null").count() == 3
    filled = impute.Imputer("auto", order_by=["c"]).fit_transform(df)
    assert rows(filled, "c")[1][0] == 2.0  # one column alone has no distance: the mean
    words = spark.createDataFrame([(None, 1)], "w string, n int")
    assert impute.impute_default(words).first()["w"] == "MISSING"


def test_anomalies(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 10, 10, 10, 1000])], "id long, val long")
    assert rows(anomalies.iqr_anomalies(df, ["id"], ["val"]).select("id", "score"), "id") == [(4, 1000.0)]
    assert anomalies.zscore_anomalies(df, ["id"], ["val"]).count() == 0  # largest z of 5 points is 2
    assert anomalies.zscore_anomalies(df, ["id"], ["val"], 0.0).count() == 5  # 0 is a threshold


def test_pii(spark):
    text = "mail a.b@c.org ssn 123-45-6789 from 10.0.0.1, card 4111 1111 1111 1111"
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "id long, t string")
    found = pii.detect(df, ["id"], ["t"], ["email", "ssn", "ip_address", "credit_card"]).collect()
    assert {(r["pii_type"], r["match"]) for r in found} == {
        ("email", "a.b@c.org"), ("ssn", "123-45-6789"), ("ip_address", "10.0.0.1"),
        ("credit_card", "4111 1111 1111 1111")}
    assert all(text[r["start"]:r["end"]] == r["match"] for r in found)
    masked = pii.mask(df, ["t"], strategy="token", pii_types=["email", "ssn"])
    assert rows(masked, "id")[0][1].startswith("mail <EMAIL_REDACTED> ssn <SSN_REDACTED> from")
    assert rows(masked, "id")[1][1] is None and rows(masked, "id")[2][1] == "nothing here"
    again = pii.detect(pii.mask(df, ["t"]), ["id"], ["t"])
    assert again.count() == 0
    by_name = pii.mask_by_name(spark.createDataFrame([("x", "me@a.b c"), (None, "1")], "email string, note string"))
    assert rows(by_name, F.desc("email")) == [("***MASKED***", "***MASKED***"), (None, "1")]


def test_long_text_masks_in_linear_time(spark):
    long = "word " * 60_000 + "x@y.z " + "tail " * 60_000
    df = spark.createDataFrame([(long,)], "note string")
    assert pii.mask_by_name(df).first()["note"] == "***MASKED***"


def test_names_and_types(spark):
    assert schema.snake_case("CustomerID") == "customer_i_d"
    assert schema.snake_case_acronym("CustomerID") == "customer_id"
    assert schema.normalize_names(["A b", "a-b", "aB", "x%"]) == ["a_b", "a_b_1", "a_b_2", "x_"]
    df = spark.createDataFrame([(str(i), "x", "NaN") for i in range(30)], "n string, c string, t string")
    typed = schema.standardize_types(df)
    assert dict(typed.dtypes) == {"n": "double", "c": "string", "t": "string"}
    assert schema.categorical_columns(typed) == ["c", "t"]


def test_validation(spark):
    df = spark.createDataFrame([(1, 5, "ab"), (2, None, "zz"), (2, 50, None)], "id int, v int, s string")
    rules = json.dumps({"columns": {"id": {"unique": True}, "v": {"not_null": True, "max": 10},
                                    "s": {"pattern": "[a-c]+"}, "gone": {"not_null": True}}})
    found = validate.validate(df, rules, ["id"]).collect()
    assert {(r["column"], r["rule"]) for r in found} == {
        ("id", "unique"), ("v", "not_null"), ("v", "range"), ("s", "pattern"), ("gone", "exists")}
    bad = validate.validate(df, {"columns": {"s": {"pattern": "("}}}, ["id"]).collect()
    assert [r["message"] for r in bad] == ["invalid pattern ("]
    with pytest.raises(validate.ValidationError):
        validate.validate(df, rules, ["id"], raise_on_error=True)
    assert validate.validate(df, "columns:\n  id:\n    min: 0\n", ["id"]).count() == 0


def test_kpis(spark):
    df = spark.createDataFrame([(100, "a"), (200, "b"), (300, "a"), (400, "c"), (500, "b")],
                               "Sales long, customer string")
    got = dict(rows(kpi.kpis(df, "retail"), "kpi"))
    assert got == {"Total Sales": 1500.0, "Customer Count": 3.0}
    assert kpi.kpis(df, "finance").count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("2024-03-05",), ("5/3/2024",), ("03/25/2024",), ("05-Mar-2024",),
                                ("2024-03-05T01:02:03+02:00",), ("1/2/70",), ("nope",)], "s string")
    got = [str(r[0]) for r in df.select(scalars.parse_datetime(F.col("s"))).collect()]
    assert got == ["2024-03-05 00:00:00", "2024-03-05 00:00:00", "2024-03-25 00:00:00",
                   "2024-03-05 00:00:00", "2024-03-04 23:02:03", "1970-01-02 00:00:00", "None"]
    one = spark.createDataFrame([("  ＡＢＣ \n", "a'b; DROP x--")], "u string, q string").select(
        scalars.normalize_string(F.col("u")), scalars.prevent_injection(F.col("q"))).first()
    assert tuple(one) == ("abc", "a''b  x")


def test_readers(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    assert read_csv(spark, str(tmp_path / "latin.csv")).first()["name"] == "café"
    (tmp_path / "bad.csv").write_text("a,b\n1,2,3\n4\n5,6\n")
    bad = read_csv(spark, str(tmp_path / "bad.csv"), "a int, b int", corrupt_column="broken")
    assert sorted(r["broken"] or "" for r in bad.cache().collect()) == ["", "1,2,3", "4"]
    (tmp_path / "list.json").write_text('[{"a": 1, "b": 2}, {"a": 3, "b": 4}]')
    assert read_json(spark, str(tmp_path / "list.json")).count() == 2
    (tmp_path / "lists.json").write_text('{"x": [{"a": 1}], "y": [{"a": 2}, {"b": 3}]}')
    assert read_json(spark, str(tmp_path / "lists.json")).count() == 3
    (tmp_path / "many.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert read_json(spark, str(tmp_path / "many.json")).count() == 3
    (tmp_path / "one.json").write_text('{"a": {"b": 1, "c": {"d": "z"}}}')
    assert read_json(spark, str(tmp_path / "one.json")).columns == ["a.b", "a.c.d"]
    (tmp_path / "r.xml").write_text("<root><row><a>1</a><b>2</b></row><row><a>3</a><b>4</b></row></root>")
    assert rows(read_xml(spark, str(tmp_path / "r.xml")), "a") == [("1", "2"), ("3", "4")]


def test_catalog_and_batch(spark, tmp_path):
    content = {"a.csv": b"a,b\n1,2\n", "b.json": b'[{"a": 1}]', "c.xml": b"<r><i><a>1</a></i></r>",
               "d.pdf": b"%PDF-1.4", "e.xlsx": b"PK\x03\x04rest", "f.sql": b"CREATE TABLE t (a int);",
               "g.bin": b"plain words", "h.json": b"{broken"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    got = {r["file"].rsplit("/", 1)[-1]: r["type"] for r in file_catalog(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "csv", "b.json": "json", "c.xml": "xml", "d.pdf": "pdf", "e.xlsx": "excel",
                   "f.sql": "sqldump", "g.bin": "unknown", "h.json": "json"}
    frames, report = batch_ingest(spark, str(tmp_path))
    status = {r["file"].rsplit("/", 1)[-1]: r["status"] for r in report.collect()}
    assert status["a.csv"] == status["b.json"] == status["c.xml"] == "ok"
    assert status["d.pdf"] == status["g.bin"] == status["h.json"] == "failed" and len(status) == 8
    assert frames["csv"].count() == 1


def test_insert_escaping(spark):
    df = spark.createDataFrame([(1, "O'Reilly", 2.5, True), (2, "a\\b", None, None)],
                               "id int, s string, d double, f boolean")
    sql = insert_statements(df, "t", ["id"]).first()["sql"]
    assert sql.endswith("(1, 'O''Reilly', 2.5, TRUE),\n  (2, 'a\\b', NULL, NULL);")
    mysql = insert_statements(df, "t", ["id"], dialect="mysql").first()["sql"]
    assert "'a\\\\b'" in mysql


def test_sql_gate(spark, raw):
    assert run_sql(spark, "select count(*) as n from people where age > :a", {"people": raw}, {"a": 35}
                   ).first()["n"] == 3
    for text in ("", "select 1;-- x", "select /* x */ 1", "exec xp_cmdshell"):
        with pytest.raises(ValueError):
            check_sql(text)


def test_cleaning_steps(spark, raw, tmp_path):
    steps = CleaningSteps(["deduplicate", "double"], {"double": lambda d: d.withColumn("income", F.col("income") * 2)})
    assert steps.run(raw).agg(F.sum("income")).first()[0] == 2000
    assert [n for n, _ in steps.history] == ["start", "deduplicate", "double"]
    assert steps.rollback().agg(F.sum("income")).first()[0] == 1000
    with pytest.raises(StepError) as failed:
        CleaningSteps(["deduplicate", "absent"]).run(raw)
    assert failed.value.name == "absent" and len(failed.value.history) == 2
    raw.write.csv(str(tmp_path / "raw"), header=True)
    out = run_cleaning(spark, str(tmp_path / "raw"), "csv", drop_duplicates=True, fillna="mean", columns="id, age")
    assert rows(out, "id")[1] == (2, 40.0)
