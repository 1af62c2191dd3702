"""Exact nearest neighbours of weighted points, and what is built on them: imputation, outlier factors, oversampling.

The search itself is in `kdsearch`. Copies of a point are one weighted point, so a crowd of equal rows costs as much as
one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import join_groups
from .kdsearch import kd_search
from .ordered import number_rows
from .profile import nan_to_null, numeric_columns, require_columns

LOF_NEIGHBORS, LOF_THRESHOLD = 20, 1.5   # fixed values
LOF_TINY = 1e-10                         # fixed value: keeps the density finite
SMOTE_NEIGHBORS = 5                      # fixed value


def _coordinates(columns: Sequence[str]):
    """The columns as one array of numbers, NaN for a gap."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])


def nearest(queries: DataFrame, points: DataFrame, coords: Sequence[str], k: int) -> DataFrame:
    """(q, p, dist, w): for each query the closest points whose weights reach `k`.

    `queries` has columns q and coords; `points` has p, coords and the weight w. Ids are
    unique; ties go to the smaller p. Exact in any number of dimensions.
    """
    asked = cut_lineage(queries.select("q", _coordinates(coords).alias("x")).withColumn("qid", F.monotonically_increasing_id()))
    held = cut_lineage(number_rows(points.select("p", _coordinates(coords).alias("x"), F.col("w").cast("bigint").alias("w")),
                                   [], ["p"], "rank"))
    found = kd_search(asked, held, len(coords), k)
    return found.join(asked.select("qid", "q"), "qid").join(held.select("rank", "p"), "rank").select(
        "q", "p", "dist", F.least("w", F.lit(k) - F.col("before")).alias("w"))


# -- imputation -------------------------------------------------------------------------------

def knn_impute(df: DataFrame, columns: Sequence[str], row_id: Sequence[str], k: int = 3) -> DataFrame:
    """Fill each missing value with the mean of the k nearest rows that have it.

    Distances use the columns both rows have, scaled up for those they lack; ties go by
    `row_id`; with no usable neighbour the column mean is used. All patterns of gaps are one search.
    """
    columns = list(columns)
    require_columns(df, [*columns, *row_id])
    if not row_id:
        raise ValueError("row_id is required to break ties between neighbours")
    base = nan_to_null(df)
    rows = base.select(F.struct(*row_id).alias("p"), _coordinates(columns).alias("x"))
    means = base.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    # Only the first k of equal rows can be chosen; a crowd of them is thinned in shares before it meets.
    share = F.pmod(F.xxhash64("p"), F.lit(64))
    thin = rows
    for group in ([F.col("x"), share], [F.col("x")]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("p"))
        thin = thin.withColumn("__r", place).filter(F.col("__r") <= k).drop("__r")
    held = cut_lineage(number_rows(thin.filter(F.exists("x", lambda v: ~F.isnan(v))), [], ["p"], "rank").withColumn(
        "w", F.lit(1).cast("bigint")))
    gappy = rows.filter(F.exists("x", F.isnan)).select("x").distinct()
    asked = cut_lineage(gappy.withColumn("qid", F.monotonically_increasing_id()))
    found = kd_search(asked, held, len(columns), k, fill=True)
    answers = (found.groupBy("qid", "c").agg(F.avg("v").alias("v"))
               .groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("__a"))
               .join(asked, "qid").select(F.col("x").alias("__x"), "__a"))
    out = join_groups(base.withColumn("__x", _coordinates(columns)), cut_lineage(answers), ["__x"])
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.try_element_at("__a", F.lit(i)), F.lit(means[c]))
                            for i, c in enumerate(columns)}).drop("__x", "__a")


# -- local outlier factor ----------------------------------------------------------------------

def local_outlier_factor(df: DataFrame, row_id: Sequence[str], columns: Sequence[str] | None = None,
                         k: int = LOF_NEIGHBORS) -> DataFrame:
    """(row_id, lof) for rows without missing values; a row is not its own neighbour."""
    columns = list(columns or numeric_columns(df))
    require_columns(df, [*row_id, *columns])
    rows = nan_to_null(df).dropna(subset=columns).select(
        F.struct(*row_id).alias("__id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    coords = [f"x{i}" for i in range(len(columns))]
    points = cut_lineage(rows.groupBy(*coords).agg(F.min("__id").alias("p"),
                                                   F.count(F.lit(1)).alias("w")))
    total = rows.count()
    k = min(k, total - 1)
    if k < 1:
        return rows.select("__id.*", F.lit(None).cast("double").alias("lof"))
    near = nearest(points.select(F.col("p").alias("q"), *coords), points, coords, k + 1)
    # one unit of the own point's weight is the row itself
    near = near.withColumn("w", F.when(F.col("q") == F.col("p"), F.col("w") - 1).otherwise(F.col("w")))
    near = cut_lineage(near.filter("w > 0"))
    reach = near.groupBy("q").agg(F.max("dist").alias("kdist"))
    reached = near.join(reach.select(F.col("q").alias("p"), F.col("kdist")), "p")
    density = reached.groupBy("q").agg((F.lit(1.0) / (F.sum(F.col("w") * F.greatest("kdist", "dist"))
                                                     / F.sum("w") + LOF_TINY)).alias("lrd"))
    around = near.join(density.select(F.col("q").alias("p"), F.col("lrd").alias("lrd_o")), "p")
    factor = around.groupBy("q").agg((F.sum(F.col("w") * F.col("lrd_o")) / F.sum("w")).alias("__o")).join(
        density, "q").select(F.col("q").alias("p"), (F.col("__o") / F.col("lrd")).alias("lof"))
    scored = points.join(factor, "p").select(*coords, "w", "lof")
    return join_groups(rows, scored, coords, size="w", how="inner").select("__id.*", "lof")


def lof_anomalies(df: DataFrame, row_id: Sequence[str], columns: Sequence[str] | None = None,
                  k: int = LOF_NEIGHBORS, threshold: float = LOF_THRESHOLD) -> DataFrame:
    """(row_id, column, score, severity) of rows in sparse neighbourhoods."""
    scores = local_outlier_factor(df, row_id, columns, k)
    return scores.filter(F.col("lof") > threshold).select(
        *row_id, F.lit("combined").alias("column"), F.col("lof").alias("score"),
        F.col("lof").alias("severity"))


# -- oversampling ---------------------------------------------------------------------------------

def smote(df: DataFrame, label: str, features: Sequence[str], row_id: Sequence[str],
          k: int = SMOTE_NEIGHBORS, seed: int = 42) -> DataFrame:
    """Original rows (features and label) plus synthetic ones until all classes are level.

    A synthetic row lies between a minority row and one of its k nearest of the same class;
    which neighbour and how far follow from a hash of (row, copy, seed).
    """
    features = list(features)
    base = df.dropna(subset=[label, *features]).select(
        F.struct(*row_id).alias("p"), F.col(label).alias("label"),
        *[F.col(c).cast("double").alias(c) for c in features])
    sizes = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = base.select(*features, F.col("label").alias(label), F.lit(False).alias("synthetic"))
    most = max(sizes.values(), default=0)
    for value, n in sorted(sizes.items(), key=lambda kv: str(kv[0])):
        need = most - n
        if not need or n < 2:
            continue
        rows = cut_lineage(base.filter(F.col("label") == F.lit(value)))
        # equal rows are interchangeable as neighbours: a crowd of copies is one weighted point
        points = rows.groupBy(*features).agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("w"))
        points = cut_lineage(points)
        near = nearest(points.select(F.col("p").alias("q"), *features), points, features, k + 1)
        near = near.withColumn("w", F.when(F.col("q") == F.col("p"), F.col("w") - 1).otherwise(F.col("w")))
        lists = (near.filter("w > 0").groupBy("q").agg(F.array_sort(F.collect_list(
            F.struct("dist", "p", "w"))).alias("l")).select("q", F.flatten(F.transform(
                "l", lambda s: F.array_repeat(s["p"], s["w"].cast("int")))).alias("near")))
        placed = number_rows(rows.withColumn("__h", F.xxhash64("p", F.lit(seed))), [], ["__h", "p"], "__rn")
        copies = F.lit(need // n) + (F.col("__rn") <= need % n).cast("bigint")
        todo = placed.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
        owner = points.join(lists, points["p"] == lists["q"]).select(*features, "w", "near")
        asked = join_groups(todo, owner, features, size="w", how="inner")
        pick = F.pmod(F.xxhash64("p", "copy", F.lit(seed)), F.size("near")).cast("int")
        share = F.pmod(F.xxhash64("copy", "p", F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0
        drawn = asked.select(*features, F.get("near", pick).alias("__o"), share.alias("__u"))
        other = points.select(F.col("p").alias("__o"), *[F.col(c).alias(f"__n_{c}") for c in features])
        made = drawn.join(other, "__o").select(
            *[(F.col(c) + F.col("__u") * (F.col(f"__n_{c}") - F.col(c))).alias(c) for c in features],
            F.lit(value).alias(label), F.lit(True).alias("synthetic"))
        out = out.unionByName(made)
    return out
