"""Column names, types, schema checks and inference."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import NUMERIC_TEXT
from .profile import missing, one_pass, require_columns, text_columns
from .quantiles import distinct_counts

# Standard names for common spellings.
COLUMN_MAPPINGS = {
    "userId": "user_id",
    "UserID": "user_id",
    "createdAt": "created_at",
    "CreatedAt": "created_at",
    "emailAddress": "email",
    "Email": "email",
    "FullName": "full_name",
    "fullName": "full_name",
}
# SQL type per Spark type name (timestamps keep their time of day).
SQL_TYPES = {
    "tinyint": "INTEGER",
    "smallint": "INTEGER",
    "int": "INTEGER",
    "bigint": "INTEGER",
    "float": "FLOAT",
    "double": "FLOAT",
    "boolean": "BOOLEAN",
    "string": "TEXT",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}
NUMERIC_SHARE = 0.8        # fixed value: text becomes numeric above this share of all rows
CATEGORY_LIMIT = 20        # fixed value: distinct values of a categorical column
SKETCH_MARGIN = 0.3        # six standard errors of the distinct-count sketch
KEY_SHARE = 0.98           # fixed value: distinct share that makes a key candidate


def select_columns(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Projection from a list or a comma-separated string; names all absent columns at once."""
    if isinstance(columns, str):
        columns = [c.strip() for c in columns.split(",") if c.strip()]
    require_columns(df, columns)
    return df.select(*columns)


def snake_case(name: str) -> str:
    """Every inner capital starts a word: CustomerID -> customer_i_d."""
    spaced = "".join("_" + ch if i and "A" <= ch <= "Z" else ch for i, ch in enumerate(name))
    return re.sub("_{2,}", "_", re.sub("[- ]", "_", spaced)).lower()


def snake_case_column(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"(?<!^)(?=[A-Z])", "_")
    return F.lower(F.regexp_replace(F.regexp_replace(spaced, "[- ]", "_"), "_{2,}", "_"))


# Word boundaries of the acronym-aware rule.
_WORD_START = r"(.)([A-Z][a-z]+)"
_LOWER_UPPER = r"([a-z0-9])([A-Z])"


def snake_case_acronym(name: str) -> str:
    """Runs of capitals stay together: CustomerID -> customer_id."""
    split = re.sub(_LOWER_UPPER, r"\1_\2", re.sub(_WORD_START, r"\1_\2", name))
    return re.sub("[ -]", "_", split).lower()


def snake_case_acronym_column(c: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(c, _WORD_START, "$1_$2"), _LOWER_UPPER, "$1_$2")
    return F.lower(F.regexp_replace(split, "[ -]", "_"))


def normalize_names(names: Sequence[str]) -> list[str]:
    """snake_case, only [a-z0-9_], collisions numbered _1, _2, ..."""
    out: list[str] = []
    taken: set[str] = set()
    for name in names:
        base = re.sub("[^a-z0-9_]", "_", snake_case(str(name)))
        candidate, n = base, 0
        while candidate in taken:
            n += 1
            candidate = f"{base}_{n}"
        taken.add(candidate)
        out.append(candidate)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_names(df.columns))


def rename_columns(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename the columns that are present; other map entries are ignored."""
    return df.withColumnsRenamed(dict(COLUMN_MAPPINGS if mapping is None else mapping))


def to_number(c: Column) -> Column:
    """Numeric text to double, anything else to null (try_cast alone accepts '1d' and 'NaN')."""
    text = F.trim(c)
    return F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))


def to_datetime(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def standardize_types(df: DataFrame, date_columns: Sequence[str] = (),
                      category_limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Dates coerced; text that is mostly numeric converted; small domains tagged categorical.

    One scan decides the casts; exact distinct counts run only for columns whose
    estimate is near the limit. The tag is column metadata, values are unchanged.
    """
    require_columns(df, date_columns)
    others = [c for c in df.columns if c not in date_columns]
    texts = [c for c in text_columns(df) if c in others]
    if not others:
        return df.withColumns({c: to_datetime(F.col(c).cast("string")) for c in date_columns})
    stats = {r["column"]: r for r in one_pass(df, {c: {
        "n": F.count(F.lit(1)),
        "numbers": F.count(to_number(F.col(c))) if c in texts else F.lit(0).cast("bigint"),
        "distinct": F.approx_count_distinct(c, 0.05),
    } for c in others}).collect()}
    numeric = [c for c in texts if stats[c]["numbers"] > NUMERIC_SHARE * stats[c]["n"]]
    converted = df.withColumns({
        **{c: to_datetime(F.col(c).cast("string")) if c in texts or c not in numeric else F.col(c)
           for c in date_columns},
        **{c: to_number(F.col(c)) for c in numeric},
    }) if date_columns or numeric else df
    near = [c for c in others if stats[c]["distinct"] <= 2 * category_limit]
    exact = distinct_counts(converted, near) if near else {}
    small = {c for c, n in exact.items() if n <= category_limit}
    return converted.select(*[
        F.col(c).alias(c, metadata={"categorical": True}) if c in small else F.col(c)
        for c in converted.columns])


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if (f.metadata or {}).get("categorical")]


def clean_schema(df: DataFrame, date_columns: Sequence[str] = (),
                 category_limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Normalise names, then types; `date_columns` uses the normalised names."""
    return df.transform(normalize_columns).transform(
        lambda d: standardize_types(d, date_columns, category_limit))


def schema_issues(df: DataFrame, template: Mapping[str, str]) -> DataFrame:
    """(column, issue, expected, actual) against a map of column to Spark type name."""
    actual = dict(df.dtypes)
    rows = []
    for c, expected in template.items():
        if c not in actual:
            rows.append((c, "missing column", expected, None))
        elif actual[c] != expected:
            rows.append((c, "type mismatch", expected, actual[c]))
    return df.sparkSession.createDataFrame(
        rows, "column string, issue string, expected string, actual string")


def detect_primary_keys(df: DataFrame, user_keys: Sequence[str] | None = None,
                        max_cardinality: float = KEY_SHARE) -> DataFrame:
    """(column, n_rows, n_distinct) of key candidates: no nulls, and (nearly) all values distinct.

    A sketch in one scan rules out most columns; exact counts run on the survivors.
    """
    if user_keys:
        require_columns(df, user_keys)
        survivors = list(user_keys)
    else:
        rows = one_pass(df, {c: {
            "n": F.count(F.lit(1)), "nulls": F.count_if(missing(df, c)),
            "distinct": F.approx_count_distinct(c, 0.05)} for c in df.columns}).collect()
        survivors = [r["column"] for r in rows
                     if r["n"] and not r["nulls"]
                     and r["distinct"] / r["n"] >= max_cardinality - SKETCH_MARGIN]
    total = df.count()
    exact = distinct_counts(df, survivors) if survivors else {}
    keys = [(c, total, n) for c, n in exact.items()
            if user_keys or (total and n / total >= max_cardinality)]
    return df.sparkSession.createDataFrame(keys, "column string, n_rows bigint, n_distinct bigint")


def infer_schema(df: DataFrame, table_name: str, type_overrides: Mapping[str, str] | None = None,
                 key_overrides: Sequence[str] | None = None,
                 type_map: Mapping[str, str] | None = None,
                 detect_booleans: bool = False) -> DataFrame:
    """One row per column: table, position, column, sql_type, nullable, primary_key.

    `detect_booleans` also types text columns holding only 0/1/true/false as BOOLEAN.
    """
    kinds = {**SQL_TYPES, **(type_map or {})}
    overrides = type_overrides or {}
    texts = set(text_columns(df)) if detect_booleans else set()
    stats = {r["column"]: r for r in one_pass(df, {c: {
        "nulls": F.count_if(missing(df, c)),
        "present": F.count(c),
        "flags": (F.count_if(F.lower(c).isin("0", "1", "true", "false"))
                  if c in texts else F.lit(-1).cast("bigint")),
    } for c in df.columns}).collect()}
    keys = {r["column"] for r in detect_primary_keys(df, key_overrides).collect()}
    rows = []
    for i, (c, kind) in enumerate(df.dtypes):
        sql_type = kinds.get(kind, "DECIMAL" if kind.startswith("decimal") else "TEXT")
        if c in texts and stats[c]["present"] and stats[c]["flags"] == stats[c]["present"]:
            sql_type = "BOOLEAN"
        rows.append((table_name, i, c, overrides.get(c, sql_type),
                     stats[c]["nulls"] > 0, c in keys))
    return df.sparkSession.createDataFrame(
        rows, "table_name string, position int, column string, sql_type string, "
              "nullable boolean, primary_key boolean")


def drop_null_labels_fill_means(train: DataFrame, label: str, features: Sequence[str],
                                *others: DataFrame) -> list[DataFrame]:
    """Drop rows without a label; fill features with means of the training rows everywhere."""
    kept = train.filter(F.col(label).isNotNull())
    means = kept.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    fill = {c: m for c, m in means.items() if m is not None}

    def apply(d: DataFrame) -> DataFrame:
        return d.withColumns({c: F.col(c).cast(T.DoubleType()) for c in features}).fillna(fill)

    return [apply(kept), *[apply(d) for d in others]]
