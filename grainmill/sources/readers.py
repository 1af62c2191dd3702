"""Readers for CSV, JSON, XML and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.topk import union_by_name
from .heads import file_heads, record_tag

FORMATS = ("csv", "json", "xml", "parquet")
Paths = str | Sequence[str]


def _list(path: Paths) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _decoded(name: str, shown: str | None = None):
    """Text that was read byte by byte: UTF-8 where its bytes are valid UTF-8, else Latin-1 as it stands."""
    column = F.col(f"`{name}`")
    return F.coalesce(F.try_validate_utf8(F.encode(column, "ISO-8859-1").cast("string")), column).alias(shown or name)


def _decoded_name(name: str) -> str:
    try:
        return name.encode("latin-1").decode("utf-8").removeprefix("\ufeff")
    except UnicodeError:
        return name


def read_csv(spark: SparkSession, path: Paths, schema: T.StructType | str | None = None,
             encoding: str | None = None, corrupt_column: str | None = None, source_file: str | None = None,
             **options: str) -> DataFrame:
    """CSV with a header. Without `encoding`, text that is not UTF-8 is taken as Latin-1, value by value in one scan.

    `corrupt_column` keeps malformed lines in that column instead of dropping fields silently.
    `source_file` names a column for the file of each row.
    Pass a schema for large inputs: inference reads the data twice.
    """
    files = _list(path)
    # Latin-1 keeps every byte as one character, and no byte of a longer UTF-8 character is a delimiter.
    reader = spark.read.options(header=True, encoding=encoding or "ISO-8859-1", mode="PERMISSIVE", **options)
    shape = schema
    if isinstance(shape, str):
        shape = spark.createDataFrame([], shape).schema
    if shape is None:
        shape = reader.option("inferSchema", True).csv(files).schema
    names = {f.name: f.name if schema is not None or encoding is not None else _decoded_name(f.name) for f in shape.fields}
    if corrupt_column:
        shape = T.StructType([*shape.fields, T.StructField(corrupt_column, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
        names[corrupt_column] = corrupt_column
    out = reader.schema(shape).csv(files)
    columns = [_decoded(f.name, names[f.name]) if encoding is None and isinstance(f.dataType, T.StringType)
               else F.col(f"`{f.name}`").alias(names[f.name]) for f in shape.fields]
    if source_file:
        columns.append(F.col("_metadata.file_path").alias(source_file))
    return out.select(columns)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct fields become columns with dotted names; arrays stay as they are."""
    def leaves(fields, path: tuple[str, ...]):
        for f in fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, here)
            else:
                yield here

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path))
                       for path in leaves(df.schema.fields, ())])


def union_lists(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record of every list column, stacked by field name; `keep` columns go along."""
    frames = [df.select(*keep, F.explode(F.col(f"`{f.name}`")).alias("r")).select("r.*", *keep)
              for f in df.schema.fields if f.name not in keep]
    return union_by_name(frames)


def read_json(spark: SparkSession, path: Paths, lines: bool | None = None,
              schema: T.StructType | str | None = None) -> DataFrame:
    """An array of records, an object of record lists (stacked), or one object (flattened), for each file its own.

    One record per line is recognised (or declared by `lines=True`); it splits, so prefer it
    for large data. A malformed document is an error, malformed lines are rows of NULLs. Files of different shapes
    are stacked by column name.
    """
    paths = _list(path)

    def read(files: list[str], **options: str | bool) -> DataFrame:
        reader = spark.read.options(**options)
        return (reader if schema is None else reader.schema(schema)).json(files)

    if lines:
        return read(paths)
    if lines is not None:
        groups = {"list": paths}
    else:
        found = file_heads(spark, paths).filter("length > 0").select("file", "shape").collect()
        groups: dict[str, list[str]] = {}
        for r in found:  # what could not be looked at is read as one document and fails or not
            groups.setdefault(r["shape"] if r["shape"] in ("lines", "lists", "object") else "list", []).append(r["file"])
        if len(groups) <= 1:
            groups = {shape: paths for shape in groups or ("list",)}
    frames = []
    for shape, files in sorted(groups.items()):
        if shape == "lines":
            frames.append(read(files))
        else:
            df = read(files, multiLine=True, mode="FAILFAST")
            frames.append({"lists": union_lists, "object": flatten}.get(shape, lambda d: d)(df))
    return union_by_name(frames)


def guess_row_tag(spark: SparkSession, paths: list[str]) -> str:
    """Name of the first element inside the root; prolog, comments and doctype are passed over, whatever their length."""
    lines = spark.read.text(paths).toLocalIterator()
    return record_tag((row["value"] + "\n").encode() for row in lines)


def read_xml(spark: SparkSession, path: Paths, record_tag: str | None = None) -> DataFrame:
    """One row per record element; child elements are text columns. A tag that matches nothing is an error."""
    tag = record_tag or guess_row_tag(spark, _list(path))
    out = (spark.read.format("xml").option("rowTag", tag).option("inferSchema", False)
           .option("excludeAttribute", True).load(path))
    if not out.columns:
        raise ValueError(f"no element <{tag}> found")
    return out


def read_parquet(spark: SparkSession, path: Paths) -> DataFrame:
    return spark.read.parquet(*_list(path))


def read_any(spark: SparkSession, path: Paths, fmt: str | None = None) -> DataFrame:
    """Dispatch by format name or file extension."""
    name = fmt or _list(path)[0].rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "json": read_json, "xml": read_xml, "parquet": read_parquet}
    if name not in readers:
        raise ValueError(f"unsupported file type: {name}; supported: {FORMATS}")
    return readers[name](spark, path)
