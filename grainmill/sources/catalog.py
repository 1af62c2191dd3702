"""File catalogue: type detection as a Spark job, and ingestion of mixed folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.topk import union_by_name
from ..session import cut_lineage
from .heads import FIELDS, UNREACHABLE, empty_files, file_heads, plain_path, through_spark
from .readers import flatten, read_csv, read_xml, union_lists

# Type per extension.
EXTENSIONS = {
    "csv": "csv",
    "xls": "excel",
    "xlsx": "excel",
    "json": "json",
    "xml": "xml",
    "pdf": "pdf",
    "parquet": "parquet",
    "sql": "sqldump",
}
REPORT = "file string, type string, status string, rows bigint, error string"
CORRUPT = "__corrupt"


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, extension, sniffed, shape, error, type); the content has the last word.

    `shape` is the JSON shape, the CSV header, the columns of a Parquet file or the record tag of XML. `error` says what
    is wrong with a file. Files of any size are typed by their content.
    """
    heads = cut_lineage(file_heads(spark, path))
    seen = heads.select("file", F.coalesce(F.col("error").startswith(UNREACHABLE), F.lit(False)).alias("unread")).collect()
    unread = [r["file"] for r in seen if r["unread"]]
    empty = empty_files(spark, path, [r["file"] for r in seen])
    if empty:
        heads = heads.unionByName(spark.createDataFrame([(f, 0, None, None, None) for f in empty], f"file string, length bigint, {FIELDS}"))
    if unread:
        again = through_spark(spark, unread)
        heads = heads.join(again.select("file"), "file", "left_anti").unionByName(again)
    kinds = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    extension = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.try_element_at(kinds, extension)
    return heads.select(
        "file", "length", extension.alias("extension"), "sniffed", "shape", "error",
        F.coalesce("sniffed", F.when(F.col("length") > 0, by_name), F.lit("unknown")).alias("type"))


def batch_ingest(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(frame per type, report). One read for each type and shape, however many files there are.

    Every frame has a `source_file` column. The report lists each file once. A file whose head or footer is broken, and
    a JSON document that is broken anywhere, fails alone; malformed lines of a file of lines are left out and counted.
    """
    listing = file_catalog(spark, path).orderBy("file").collect()
    frames: dict[str, list[DataFrame]] = {}
    report: list[tuple] = []
    groups: dict[tuple[str, str | None], list[str]] = {}
    for r in listing:
        kind = r["type"]
        if kind not in ("csv", "parquet", "json", "xml"):
            report.append((r["file"], kind, "failed", None, "unsupported file type"))
        elif r["error"] is not None and not r["error"].startswith(UNREACHABLE):
            report.append((r["file"], kind, "failed", None, r["error"]))
        elif r["sniffed"] is None and not r["error"]:
            report.append((r["file"], kind, "failed", None, f"content is not {kind}"))
        else:
            groups.setdefault((kind, r["shape"]), []).append(r["file"])
    pending = sorted(groups.items(), key=lambda g: (g[0][0], g[0][1] or ""))
    while pending:
        (kind, shape), files = pending.pop(0)
        try:
            good, bad = _load(spark, kind, shape, files)
            rows = {plain_path(r["source_file"]): r["n"] for r in good.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).collect()}
        except Exception as error:  # what no head shows: halve the group until the file is found
            if len(files) > 1:
                half = len(files) // 2
                pending += [((kind, shape), files[:half]), ((kind, shape), files[half:])]
            else:
                report.append((files[0], kind, "failed", None, str(error).split("\n")[0][:300]))
            continue
        frames.setdefault(kind, []).append(good)
        for f in files:
            wrong = bad.get(plain_path(f), 0)
            if wrong and shape != "lines":
                report.append((f, kind, "failed", None, "malformed document"))
            else:
                report.append((f, kind, "ok", rows.get(plain_path(f), 0), f"{wrong} malformed lines" if wrong else None))
    return {k: union_by_name(v) for k, v in sorted(frames.items())}, spark.createDataFrame(report, REPORT)


def _load(spark: SparkSession, kind: str, shape: str | None, files: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """The rows of files of one shape, and how many malformed records each file has."""
    source = F.col("_metadata.file_path").alias("source_file")
    if kind == "csv":
        return read_csv(spark, files, source_file="source_file"), {}
    if kind == "parquet":
        return spark.read.parquet(*files).select("*", source), {}
    if kind == "xml":
        return read_xml(spark, files, shape).withColumn("source_file", F.input_file_name()), {}
    raw = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=shape != "lines").json(files)
    raw = raw.select("*", source)
    bad: dict[str, int] = {}
    if CORRUPT in raw.columns:
        raw = cut_lineage(raw)
        broken = raw.filter(F.col(CORRUPT).isNotNull()).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
        bad = {plain_path(r["source_file"]): r["n"] for r in broken.collect()}
        raw = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if shape == "lists":
        return union_lists(raw, keep=["source_file"]), bad
    return (flatten(raw) if shape == "object" else raw), bad
