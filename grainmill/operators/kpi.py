"""Business KPIs from column-name templates, and rule-based insights."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# KPI templates. A pair of columns with "ratio" divides the sum of the first by
# the sum of the second; "rate" divides it by the distinct count of the second.
TEMPLATES = {
    "finance": {
        "Total Revenue": (["revenue", "total_revenue"], "sum"),
        "Net Profit": (["net_profit", "profit"], "sum"),
        "Profit Margin": (["net_profit", "revenue"], "ratio"),
        "Return on Assets": (["net_income", "total_assets"], "ratio"),
    },
    "healthcare": {
        "Patient Count": (["patient_id", "patient"], "nunique"),
        "Average Stay": (["length_of_stay", "stay_duration"], "mean"),
        "Readmission Rate": (["readmitted", "patient_id"], "rate"),
    },
    "retail": {
        "Total Sales": (["sales", "total_sales", "amount"], "sum"),
        "Average Basket Size": (["basket_size", "items_purchased"], "mean"),
        "Customer Count": (["customer_id", "customer"], "nunique"),
    },
    "logistics": {
        "Total Shipments": (["shipment_id", "tracking_id"], "nunique"),
        "Average Delivery Time": (["delivery_time", "transit_days"], "mean"),
        "On-Time Delivery Rate": (["on_time_flag", "shipment_id"], "rate"),
    },
}
# Thresholds of the insight rules and their default lines.
HIGH_VARIANCE = 2.0
SKEWED = 1.0
STRONG, MODERATE, TOP_PAIRS = 0.9, 0.7, 3
NO_RISK = "No significant risks detected based on available data."
NO_OPPORTUNITY = "No clear opportunities identified; further domain analysis recommended."

# Lines of the summary.
KPI_HEAD = "Key KPIs identified:"
NO_KPI = "No key performance indicators (KPIs) could be computed for this dataset."

Template = Mapping[str, tuple]


def kpis(df: DataFrame, industry: str, custom: Template | None = None) -> DataFrame:
    """(kpi, value) for the templates whose columns are present; one aggregate for all.

    A custom template maps a name to (columns, func); func is a name above or a function
    from the list of found columns to an aggregate Column.
    """
    templates = {**TEMPLATES.get(industry.lower(), {}), **(custom or {})}
    actual = {c.lower(): c for c in df.columns}
    chosen: list[tuple[str, Column]] = []
    for name, (columns, func) in templates.items():
        found = [actual[c] for c in columns if c in actual]
        value = _aggregate(found, func, len(found) == len(columns)) if found else None
        if value is not None:
            chosen.append((name, value.cast("double")))
    if not chosen:
        return df.sparkSession.createDataFrame([], "kpi string, value double")
    wide = df.agg(*[v.alias(f"k{i}") for i, (_, v) in enumerate(chosen)])
    rows = F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(f"k{i}").alias("value"))
                     for i, (n, _) in enumerate(chosen)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").filter("value is not null")


def _aggregate(found: list[str], func: str | Callable[[list[str]], Column],
               complete: bool) -> Column | None:
    if callable(func):
        return func(found)
    first = found[0]
    if func == "sum":
        return F.coalesce(F.sum(first), F.lit(0))
    if func == "mean":
        return F.avg(first)
    if func == "nunique":
        return F.count_distinct(first)
    if func in ("ratio", "rate"):
        if not complete:
            return None
        below = F.sum(found[1]) if func == "ratio" else F.count_distinct(found[1])
        return F.try_divide(F.sum(F.col(first).cast("double")), below.cast("double"))
    raise ValueError(f"unknown KPI function: {func}")


def insights(profile: DataFrame, dependencies: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """(kind, subject, message) from a numeric profile, ranked dependencies and (kpi, value) rows (all small).

    With KPIs, a line of kind 'summary' for each and one above them.
    """
    quoted = F.concat(F.lit("'"), F.col("column"), F.lit("'"))

    def rule(condition: Column, text: str) -> Column:
        return F.when(condition, F.struct(
            F.lit("risk").alias("kind"), F.col("column").alias("subject"),
            F.concat(F.lit(text), quoted, F.lit(".")).alias("message")))

    rules = F.array_compact(F.array(
        rule(F.col("std") > HIGH_VARIANCE * F.abs("mean"), "High variance detected in "),
        rule(F.col("skewness") > SKEWED, "Significant right skew in "),
        rule(F.col("skewness") < -SKEWED, "Significant left skew in ")))
    found = profile.select(F.explode(rules).alias("r")).select("r.*")
    if dependencies is not None:
        top = dependencies.orderBy(F.desc("score"), "feature_1", "feature_2", "method").limit(TOP_PAIRS)
        pair = F.concat_ws("/", "feature_1", "feature_2")
        strong = F.format_string(
            "Strong dependency between '%s' and '%s' (correlation: %.2f). Consider reducing redundancy.",
            "feature_1", "feature_2", "score")
        moderate = F.format_string(
            "Moderate correlation between '%s' and '%s' (%.2f) may yield actionable insight.",
            "feature_1", "feature_2", "score")
        found = found.unionByName(top.filter(F.col("score") > MODERATE).select(
            F.when(F.col("score") > STRONG, "risk").otherwise("opportunity").alias("kind"),
            pair.alias("subject"),
            F.when(F.col("score") > STRONG, strong).otherwise(moderate).alias("message")))
    present = found.agg(F.count_if(F.col("kind") == "risk").alias("risk"),
                        F.count_if(F.col("kind") == "opportunity").alias("opportunity"))
    defaults = present.select(F.explode(F.array_compact(F.array(*[
        F.when(F.col(kind) == 0, F.struct(F.lit(kind).alias("kind"), F.lit("").alias("subject"),
                                          F.lit(text).alias("message")))
        for kind, text in (("risk", NO_RISK), ("opportunity", NO_OPPORTUNITY))]))).alias("r"))
    out = found.unionByName(defaults.select("r.*"))
    if measured is None:
        return out
    head = measured.agg(F.when(F.count(F.lit(1)) > 0, KPI_HEAD).otherwise(NO_KPI).alias("message"))
    lines = measured.select(F.col("kpi").alias("subject"), F.concat(
        F.lit("- "), "kpi", F.lit(": "), F.format_number("value", 2)).alias("message"))
    summary = head.select(F.lit("").alias("subject"), "message").unionByName(lines)
    return out.unionByName(summary.withColumn("kind", F.lit("summary")))
