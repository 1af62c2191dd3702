"""What single files are, found on executors: type by content, shape of JSON, header of CSV and Parquet, tag of XML.

Spark lists the files; tasks open them and read the first bytes, so a file of any size costs a few kilobytes (a JSON
document that is not a list of lines is read to its end, as it is by any reader). What goes wrong with a file is a value
in its row. Files that only Spark's own readers reach are read through these up to BINARY_LIMIT bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import unquote, urlsplit
from xml.parsers import expat

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNIFF_BYTES = 4096
BINARY_LIMIT = 8 * 1024 * 1024
SHAPE_BYTES = 256 * 1024 * 1024
TAG_BYTES = 1 << 16
UNREACHABLE = "unreachable"
FIELDS = "sniffed string, shape string, error string"
_BLANKS = b" \t\r\n\x0b\x0c"
_MARK = b"\xef\xbb\xbf"
_SQL = re.compile(r"(?is)^.{0,2000}\b(create\s+table|insert\s+into)\b")


def sniff(head: bytes) -> str | None:
    """Type from the first bytes of a file; None when nothing fits."""
    text = head.removeprefix(_MARK).lstrip(_BLANKS)
    if text.startswith(b"PAR1"):
        return "parquet"
    if text.startswith(b"%PDF"):
        return "pdf"
    if text.startswith((b"PK\x03\x04", b"\xd0\xcf\x11\xe0")):
        return "excel"
    if text.startswith(b"<"):
        return "xml"
    if text.startswith((b"{", b"[")):
        return "json"
    if _SQL.match(text.decode("latin-1")):
        return "sqldump"
    return "csv" if re.match(rb"[^\r\n]*[,;\t|]", text) else None


def json_shape(source) -> str:
    """'lines', 'list', 'lists' (an object of record lists) or 'object'; ValueError if the document is broken."""
    first = b""
    while not first.strip(_BLANKS):
        first = source.readline()
        if not first:
            return "lines"
        first = first.removeprefix(_MARK)
    if first.lstrip(_BLANKS).startswith(b"["):
        return "list"
    try:
        whole = json.loads(first)
        rest = source.readline()
        while rest and not rest.strip(_BLANKS):
            rest = source.readline()
        if rest:
            return "lines"
    except ValueError:
        body = source.read(SHAPE_BYTES)
        if source.read(1):  # too long to look at; its first value decides
            return "lists" if re.match(rb'\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\[\s*\{', first + body[:SNIFF_BYTES]) else "object"
        whole = json.loads(first + body)
    values = list(whole.values())
    records = [isinstance(v, list) and all(isinstance(x, dict) for x in v) for v in values]
    return "lists" if values and all(records) else "object"


class _Found(Exception):
    pass


def record_tag(chunks: Iterator[bytes]) -> str:
    """Name of the first element inside the root, by an incremental parser: each byte is looked at once."""
    seen: list[str] = []
    parser = expat.ParserCreate()

    def start(name: str, _: dict) -> None:
        seen.append(name)
        if len(seen) == 2:
            raise _Found

    parser.StartElementHandler = start
    try:
        for chunk in chunks:
            parser.Parse(chunk, False)
    except _Found:
        return seen[1]
    except expat.ExpatError as error:
        raise ValueError(f"not well-formed: {error}") from None
    raise ValueError("no record element found")


def parquet_schema(source) -> str:
    """The columns of a Parquet file, from its footer."""
    import pyarrow.parquet as pq

    schema = pq.ParquetFile(source).schema_arrow
    return ", ".join(f"{f.name} {f.type}" for f in schema)


def open_file(path: str):
    """A binary stream of a local path or of what Arrow's file systems reach."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        try:
            return open(parts.path, "rb")
        except FileNotFoundError:
            return open(unquote(parts.path), "rb")
    system, name = pafs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def look(path: str) -> dict[str, str | None]:
    """FIELDS of one file."""
    try:
        source = open_file(path)
    except Exception as error:  # any file system has errors of its own; the file is then one for Spark's readers
        return {"sniffed": None, "shape": None, "error": f"{UNREACHABLE}: {type(error).__name__}"}
    with source:
        return look_into(source)


def look_into(source) -> dict[str, str | None]:
    """FIELDS of a stream."""
    kind = sniff(source.read(SNIFF_BYTES))
    source.seek(0)
    return {"sniffed": kind, "shape": None, "error": None} | _shape(kind, source)


def file_heads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, length, sniffed, shape, error) of every file below `path`; one small job, whatever the sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.col("path").alias("file"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [look(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([s[c] for s in seen], pa.string()) for c in ("sniffed", "shape", "error"))],
                ["file", "length", "sniffed", "shape", "error"])

    return files.mapInArrow(run, f"file string, length bigint, {FIELDS}")


def empty_files(spark: SparkSession, path: str | list[str], seen: list[str]) -> list[str]:
    """Files below `path` that are not among `seen`: Spark lists files without content, but gives none of them to a task."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    known = {plain_path(s) for s in seen}
    return sorted(f for f in listed if plain_path(f) not in known and plain_path(unquote(f)) not in known)


def plain_path(path: str) -> str:
    """Path without scheme, as the readers spell it differently (file:/x, file:///x)."""
    return "/" + path.split(":", 1)[-1].lstrip("/")


def through_spark(spark: SparkSession, files: list[str]) -> DataFrame:
    """The same for files that tasks cannot open themselves; those over BINARY_LIMIT keep their error."""
    small = spark.read.format("binaryFile").load(files).filter(F.col("length") <= BINARY_LIMIT).select(
        F.col("path").alias("file"), "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [look_into(BytesIO(content.as_buffer())) for content in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([s[c] for s in seen], pa.string()) for c in ("sniffed", "shape", "error"))],
                ["file", "length", "sniffed", "shape", "error"])

    return small.mapInArrow(run, f"file string, length bigint, {FIELDS}")


def _shape(kind: str | None, source) -> dict[str, str | None]:
    try:
        if kind == "json":
            return {"shape": json_shape(source)}
        if kind == "xml":
            return {"shape": record_tag(iter(lambda: source.read(TAG_BYTES), b""))}
        if kind == "parquet":
            return {"shape": parquet_schema(source)}
        if kind == "csv":
            head = source.read(SNIFF_BYTES)
            return {"shape": head.removeprefix(_MARK).lstrip(_BLANKS).splitlines()[0].decode("latin-1")}
    except Exception as error:  # a broken file is a row of the report
        return {"error": f"{type(error).__name__}: {error}".split("\n")[0][:300]}
    return {}
