"""SQL text exports: batched INSERT statements and bulk-copy rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import number_rows
from ..operators.profile import require_columns

BATCH_ROWS = 1000  # fixed value: rows per INSERT
NULL_TEXT = "\\N"
DIALECTS = ("postgresql", "mysql", "sqlite", "standard")


def sql_literal(df: DataFrame, c: str, dialect: str = "postgresql") -> Column:
    """A value as SQL text: NULL, number, TRUE/FALSE, or a quoted string."""
    kind = dict(df.dtypes)[c]
    text = F.col(c).cast("string")
    if kind == "boolean":
        text = F.upper(text)
    elif kind in ("double", "float"):
        text = F.when(~F.isnan(c) & ~F.abs(c).isin(float("inf")), text)  # SQL has no literal for these
    elif kind not in ("tinyint", "smallint", "int", "bigint") and not kind.startswith("decimal"):
        text = F.replace(text, F.lit("'"), F.lit("''"))
        if dialect == "mysql":
            text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        text = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str, order_by: Sequence[str],
                      columns: Sequence[str] | None = None, batch_rows: int = BATCH_ROWS,
                      dialect: str = "postgresql", parameterized: bool = False) -> DataFrame:
    """(batch_id, sql[, params]): one multi-row INSERT per batch of rows in key order.

    Rows are numbered without a single-task window, and a group never exceeds a batch.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    columns = list(columns or df.columns)
    require_columns(df, [*columns, *order_by])
    numbered = number_rows(df, [], order_by, "__rn")
    if parameterized:
        row = F.array(*[F.col(c).cast("string") for c in columns])
    else:
        row = F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(df, c, dialect) for c in columns]),
                       F.lit(")"))
    batches = (numbered.select(F.floor((F.col("__rn") - 1) / batch_rows).alias("batch_id"), "__rn",
                               row.alias("__row"))
               .groupBy("batch_id")
               .agg(F.array_sort(F.collect_list(F.struct("__rn", "__row"))).alias("__rows")))
    rows = F.transform("__rows", lambda r: r["__row"])
    head = f"INSERT INTO {table} ({', '.join(columns)}) VALUES"
    if parameterized:
        marks = F.lit("(" + ", ".join(["%s"] * len(columns)) + ")")
        body = F.array_join(F.array_repeat(marks, F.size("__rows")), ", ")
        return batches.select("batch_id", F.concat(F.lit(head + " "), body, F.lit(";")).alias("sql"),
                              F.flatten(rows).alias("params"))
    return batches.select("batch_id", F.concat(F.lit(head + "\n  "), F.array_join(rows, ",\n  "),
                                               F.lit(";")).alias("sql"))


def copy_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One CSV line per row, nulls as \\N, quoting as COPY expects."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    return df.select(F.to_csv(F.struct(*columns), {
        "nullValue": NULL_TEXT, "quote": '"', "escape": '"'}).alias("line"))


def write_copy(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """The bulk payload as parallel part files."""
    copy_rows(df, columns).write.text(path)


def copy_statement(table: str, columns: Sequence[str]) -> str:
    return f"COPY {table} ({', '.join(columns)}) FROM STDIN WITH (FORMAT csv, NULL '{NULL_TEXT}');"


def load_data_statement(table: str, columns: Sequence[str], file_path: str) -> str:
    return (f"LOAD DATA INFILE '{file_path}' INTO TABLE {table} FIELDS TERMINATED BY ',' "
            f"ENCLOSED BY '\"' LINES TERMINATED BY '\\n' ({', '.join(columns)});")
