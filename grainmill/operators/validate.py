"""Declarative validation: rules per column, violations as rows.

Rules: {"columns": {name: {not_null, unique, min, max, pattern, warn_if}}}, given as a
dict, JSON or YAML text, or a path. `warn_if` is a predicate (SQL text or Column builder)
that good rows satisfy.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import missing, one_pass, require_columns

VIOLATION = ("severity string, column string, rule string, row_id string, value string, "
             "message string")


class ValidationError(Exception):
    """Raised on request when a table breaks its rules."""


def load_rules(rules: str | Mapping) -> dict:
    if isinstance(rules, Mapping):
        return dict(rules)
    text = rules
    if os.path.exists(rules):
        with open(rules, encoding="utf-8") as handle:
            text = handle.read()
    try:
        parsed = json.loads(text)
    except ValueError:
        import yaml

        parsed = yaml.safe_load(text)
    if not isinstance(parsed, dict):
        raise ValueError("rules must be a mapping")
    return parsed


def full_match(c: Column, pattern: str) -> Column:
    return c.cast("string").rlike(rf"\A(?:{pattern})\z")


def _valid_regex(df: DataFrame, pattern: str) -> bool:
    """Ask Spark itself: its regex dialect is the one that will run."""
    try:
        df.sparkSession.range(1).select(F.col("id").cast("string").rlike(pattern)).collect()
    except Exception:  # the engine reports a malformed pattern in several classes
        return False
    return True


def _predicate(rule: object, column: str) -> Column:
    return rule(F.col(column)) if callable(rule) else F.expr(str(rule))


def row_violations(df: DataFrame, rules: Mapping, row_id: Sequence[str]) -> DataFrame:
    """Range, pattern and warning violations of all columns in one scan."""
    require_columns(df, row_id)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in row_id])
    found: list[Column] = []

    def add(severity: str, column: str, rule: str, bad: Column, message: str) -> None:
        found.append(F.when(bad, F.struct(
            F.lit(severity).alias("severity"), F.lit(column).alias("column"),
            F.lit(rule).alias("rule"), key.alias("row_id"),
            F.col(column).cast("string").alias("value"), F.lit(message).alias("message"))))

    for c, spec in rules.get("columns", {}).items():
        if c not in df.columns:
            continue
        if spec.get("min") is not None:
            add("error", c, "range", F.col(c) < F.lit(spec["min"]), f"less than min {spec['min']}")
        if spec.get("max") is not None:
            add("error", c, "range", F.col(c) > F.lit(spec["max"]), f"greater than max {spec['max']}")
        if spec.get("pattern") and _valid_regex(df, spec["pattern"]):
            add("error", c, "pattern", ~full_match(F.col(c), spec["pattern"]),
                f"does not match {spec['pattern']}")
        if spec.get("warn_if"):
            add("warning", c, "warn_if", ~F.coalesce(_predicate(spec["warn_if"], c), F.lit(False)),
                "custom warning")
    if not found:
        return df.sparkSession.createDataFrame([], VIOLATION)
    return (df.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.*"))


def column_violations(df: DataFrame, rules: Mapping) -> DataFrame:
    """Missing columns, nulls, repeats and bad patterns: at most one row per column and rule."""
    specs = rules.get("columns", {})
    spark = df.sparkSession
    fixed = [("error", c, "exists", None, None, "column not found")
             for c in specs if c not in df.columns]
    fixed += [("error", c, "pattern", None, None, f"invalid pattern {s['pattern']}")
              for c, s in specs.items()
              if c in df.columns and s.get("pattern") and not _valid_regex(df, s["pattern"])]
    out = spark.createDataFrame(fixed, VIOLATION)

    def rows(counts: DataFrame, rule: str, text: str) -> DataFrame:
        return counts.filter("n > 0").select(
            F.lit("error").alias("severity"), "column", F.lit(rule).alias("rule"),
            F.lit(None).cast("string").alias("row_id"), F.lit(None).cast("string").alias("value"),
            F.concat(F.col("n").cast("string"), F.lit(text)).alias("message"))

    required = [c for c, s in specs.items() if s.get("not_null") and c in df.columns]
    if required:
        nulls = one_pass(df, {c: {"n": F.count_if(missing(df, c))} for c in required})
        out = out.unionByName(rows(nulls, "not_null", " null values"))
    for c in [c for c, s in specs.items() if s.get("unique") and c in df.columns]:
        groups = df.groupBy(c).agg(F.count(F.lit(1)).alias("k"))  # nulls form one group
        repeats = groups.agg((F.coalesce(F.sum("k"), F.lit(0)) - F.count(F.lit(1))).alias("n"))
        out = out.unionByName(rows(repeats.withColumn("column", F.lit(c)), "unique", " duplicates"))
    return out


def validate(df: DataFrame, rules: str | Mapping, row_id: Sequence[str],
             raise_on_error: bool = False) -> DataFrame:
    """All violations: (severity, column, rule, row_id, value, message)."""
    spec = load_rules(rules)
    found = column_violations(df, spec).unionByName(row_violations(df, spec, row_id))
    if raise_on_error:
        errors = found.filter("severity = 'error'").count()
        if errors:
            raise ValidationError(f"{errors} validation errors")
    return found


def report(df: DataFrame, rules: str | Mapping, row_id: Sequence[str]) -> DataFrame:
    """(column, rules_checked, n_errors, n_warnings, valid): one row per ruled column."""
    spec = load_rules(rules)
    checked = df.sparkSession.createDataFrame(
        [(c, ",".join(sorted(s))) for c, s in spec.get("columns", {}).items()],
        "column string, rules_checked string")
    counts = validate(df, spec, row_id).groupBy("column").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    return (checked.join(counts, "column", "left").fillna(0, ["n_errors", "n_warnings"])
                   .withColumn("valid", F.col("n_errors") == 0))


def fk_violations(child: DataFrame, child_keys: Sequence[str], parent: DataFrame,
                  parent_keys: Sequence[str]) -> DataFrame:
    """(child keys, n_rows) of foreign keys without a parent.

    Child keys are counted first, so the join carries one row per key however hot it is.
    """
    counts = child.dropna(subset=list(child_keys)).groupBy(*child_keys).agg(
        F.count(F.lit(1)).alias("n_rows"))
    keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_keys)])
    on = F.lit(True)
    for i, c in enumerate(child_keys):
        on = on & (counts[c] == keys[f"__p{i}"])
    return counts.join(keys, on, "left_anti")


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, n_rows) of key values that occur more than once."""
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"))
