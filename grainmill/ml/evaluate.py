"""Metrics, folds, hold-outs and metric history, computed by grouping and running totals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from hashlib import sha256
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach_row, join_groups
from ..operators.ordered import number_rows, running_totals, with_window
from ..session import cut_lineage

SEED = 42


def _long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                     for n in names])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n); texts stay texts, other classes are doubles."""
    kinds = dict(df.dtypes)
    named = [F.col(c).cast("string" if kinds[label] == "string" else "double").alias(n)
             for c, n in ((label, "label"), (prediction, "prediction"))]
    return df.groupBy(*named).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, support, precision, recall, f1); an undefined ratio is 0."""
    cm = confusion_matrix(df, label, prediction)
    by_label = cm.groupBy("label").agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))
                                           .otherwise(0)).alias("tp"))
    by_prediction = cm.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    both = by_label.join(by_prediction, "label", "left")
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return (both.withColumns({"precision": precision, "recall": recall})
                .withColumn("f1", F.coalesce(F.try_divide(
                    2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
                .select("label", "support", "tp", "precision", "recall", "f1"))


def classification_metrics(df: DataFrame, label: str, prediction: str,
                           score: str | None = None, positive: object = 1.0) -> DataFrame:
    """(metric, value): accuracy, support-weighted precision, recall and f1; AUC of `positive` with a score."""
    per = class_report(df, label, prediction)

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    wide = per.agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
                   *[weighted(c).alias(c) for c in ("precision", "recall", "f1")])
    out = _long(wide, ["accuracy", "precision", "recall", "f1"])
    if score is not None:
        out = out.unionByName(roc_auc(df, label, score, positive))
    return out


def _by_score(df: DataFrame, label: str, score: str, positive_class: object = 1.0) -> DataFrame:
    positive = F.col(label).cast("string" if isinstance(positive_class, str) else "double") == F.lit(positive_class)
    return df.filter(F.col(score).isNotNull()).groupBy((-F.col(score).cast("double")).alias("__neg")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str, positive: object = 1.0) -> DataFrame:
    """Area under the curve by rank sums: rows are counted per score before any ordering."""
    ranked = running_totals(_by_score(df, label, score, positive), [], ["__neg"], {"__above": F.col("pos")},
                            inclusive=False)
    won = F.sum(F.col("neg") * (F.col("__above") + F.col("pos") / 2))
    return _long(ranked.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc")),
                 ["roc_auc"])


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    counts = _by_score(df, label, score)
    run = running_totals(counts, [], ["__neg"], {"__tp": F.col("pos"), "__fp": F.col("neg")})
    totals = counts.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return attach_row(run, totals).select(
        (-F.col("__neg")).alias("threshold"), F.try_divide("__fp", "__n").alias("fpr"),
        F.try_divide("__tp", "__p").alias("tpr"))


def _regression(label: str, prediction: str) -> dict[str, Column]:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    mse = F.avg((y - p) * (y - p))
    return {
        "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(y - p)),
        "r2": 1 - F.try_divide(mse, F.var_pop(y)),
        "mape": F.avg(F.abs((y - p) / F.nullif(y, F.lit(0.0)))) * 100,
    }


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(metric, value): mse, rmse, mae, r2, mape in one aggregate."""
    made = _regression(label, prediction)
    both = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return _long(both.agg(*[e.alias(n) for n, e in made.items()]), list(made))


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.withColumn("residual", F.col(label) - F.col(prediction))


# -- folds ------------------------------------------------------------------------------------

def _ranked(df: DataFrame, label: str | None, row_id: Sequence[str], seed: int) -> DataFrame:
    mixed = df.withColumn("__h", F.md5(F.concat_ws("|", *row_id, F.lit(seed)).cast("binary")))
    return number_rows(mixed, [label] if label else [], ["__h", *row_id], "__rn").drop("__h")


def assign_folds(df: DataFrame, k: int, row_id: Sequence[str], label: str | None = None,
                 seed: int = SEED) -> DataFrame:
    """Add `fold` (0 to k-1), even within each class when `label` is given."""
    return _ranked(df, label, row_id, seed).withColumn(
        "fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn")


def assign_holdout(df: DataFrame, test_size: float, row_id: Sequence[str],
                   label: str | None = None, seed: int = SEED) -> DataFrame:
    """Add `split`: the first `test_size` share of a hashed order (per class) is test."""
    ranked = _ranked(df, label, row_id, seed)
    if label:
        sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
        ranked = join_groups(ranked, sizes, [label], size="__n")
    else:
        ranked = ranked.withColumn("__n", F.lit(df.count()))
    share = F.coalesce(F.try_divide(F.col("__rn") - 1, F.col("__n") - 1), F.lit(0.0))
    return ranked.withColumn("split", F.when(share < test_size, "test").otherwise("train")).drop("__rn", "__n")


Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
Score = Callable[[DataFrame], DataFrame]


def cross_validate(df: DataFrame, fit: Fit, score: Score, k: int) -> DataFrame:
    """(fold, metric, value). `df` has a `fold` column; `fit` returns a scoring function.

    Every fold reads the table, so it is written once rather than derived k times.
    """
    df = cut_lineage(df)
    parts = []
    for fold in range(k):
        predict = fit(df.filter(F.col("fold") != fold))
        parts.append(score(predict(df.filter(F.col("fold") == fold))).withColumn("fold", F.lit(fold)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_summary(scores: DataFrame) -> DataFrame:
    """(metric, mean_score, std_score) over folds."""
    return scores.groupBy("metric").agg(F.avg("value").alias("mean_score"),
                                        F.stddev_pop("value").alias("std_score"))


def backtest(df: DataFrame, fit: Fit, score: Score, n_splits: int) -> DataFrame:
    """(split, metric, value) over expanding windows; `df` has the `fold` of timeseries_folds."""
    df = cut_lineage(df)
    parts = []
    for split in range(1, n_splits + 1):
        predict = fit(df.filter(F.col("fold") < split))
        parts.append(score(predict(df.filter(F.col("fold") == split))).withColumn("split", F.lit(split)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- history ------------------------------------------------------------------------------------

METRIC_SCHEMA = "ts timestamp_ntz, run string, metric string, value double"


def record_metrics(spark: SparkSession, path: str, run: str, ts: str, metrics: Mapping[str, float],
                   expected_runs: int | None = None) -> None:
    """Add one run's metrics to a folder of Parquet files, one for each run.

    The file is written aside and then renamed, so readers see all of a run or nothing, and runs that are recorded at the
    same time do not touch each other's files. Recording a run again adds nothing; other values for it are an error, as is
    a number of runs other than `expected_runs`.
    """
    rows = [(ts, run, name, float(value)) for name, value in sorted(metrics.items())]
    made = spark.createDataFrame(rows, "ts string, run string, metric string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    target = jvm.org.apache.hadoop.fs.Path(folder, f"run-{sha256(run.encode()).hexdigest()[:32]}.parquet")
    if system.exists(target):
        if made.exceptAll(spark.read.parquet(target.toString())).union(
                spark.read.parquet(target.toString()).exceptAll(made)).isEmpty():
            return
        raise ValueError(f"run {run} is recorded with other values")
    if expected_runs is not None:
        known = len([f for f in system.listStatus(folder) if f.getPath().getName().startswith("run-")]) if system.exists(folder) else 0
        if known != expected_runs:
            raise ValueError(f"{known} runs are recorded, expected {expected_runs}")
    aside = jvm.org.apache.hadoop.fs.Path(folder, f"_aside-{uuid4().hex}")
    made.coalesce(1).write.parquet(aside.toString())
    part, = [f.getPath() for f in system.listStatus(aside) if f.getPath().getName().startswith("part-")]
    renamed = system.rename(part, target)
    system.delete(aside, True)
    if not renamed and not system.exists(target):
        raise OSError(f"{target.toString()} could not be written")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(ts, run, metric, value) of all recorded runs."""
    return spark.read.schema(METRIC_SCHEMA).parquet(path)


def metric_drift(history: DataFrame) -> DataFrame:
    """Add the change of each metric since its previous record."""
    return with_window(history, ["metric"], ["ts", "run"], lambda w: {
        "drift": F.col("value") - F.lag("value", 1).over(w)}, back=1)
