"""Parameterised SQL over registered DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Text that is refused before parsing.
REFUSED = (";--", "/*", "*/", "xp_")


def check_sql(text: str) -> str:
    if not text or not text.strip():
        raise ValueError("empty SQL")
    lowered = text.lower()
    hit = next((t for t in REFUSED if t in lowered), None)
    if hit:
        raise ValueError(f"refused token in SQL: {hit}")
    return text


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None,
            params: Mapping[str, object] | None = None) -> DataFrame:
    """One statement with `:name` parameters; values are bound, never spliced into the text."""
    for name, frame in (tables or {}).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(check_sql(text), args=dict(params or {}))
