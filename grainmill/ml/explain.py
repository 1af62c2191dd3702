"""Explanations: exact linear contributions, sampled Shapley values, local surrogates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.profile import require_columns
from .least_squares import fit_groups

Predict = Callable[[DataFrame], DataFrame]  # adds the column `output`
BACKGROUND_ROWS, PERMUTATIONS, PERTURBATIONS, SEED = 100, 8, 60, 42


def linear_contributions(df: DataFrame, row_id: Sequence[str], features: Sequence[str],
                         coefficients: Sequence[float], intercept: float) -> DataFrame:
    """(row_id, feature, contribution, base_value): coef * (x - mean), base is the mean prediction."""
    require_columns(df, [*row_id, *features])
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    base = intercept + sum(b * (means[c] or 0.0) for c, b in zip(features, coefficients))
    parts = F.array(*[F.struct(F.lit(c).alias("feature"),
                               (F.lit(float(b)) * (F.col(c) - F.lit(means[c]))).alias("contribution"))
                      for c, b in zip(features, coefficients)])
    return (df.select(*row_id, F.explode(parts).alias("p"))
              .select(*row_id, "p.*", F.lit(float(base)).alias("base_value")))


def global_importance(contributions: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute contribution."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def _uniform(*parts: object) -> Column:
    columns = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / 1_000_003.0


def sampled_shapley(df: DataFrame, row_id: Sequence[str], features: Sequence[str], predict: Predict,
                    permutations: int = PERMUTATIONS, background_rows: int = BACKGROUND_ROWS,
                    seed: int = SEED) -> DataFrame:
    """(row_id, feature, contribution) by Monte-Carlo permutations (Strumbelj and Kononenko, 2014).

    Every row walks from a background row to itself, one feature at a time in a hashed order;
    the model scores all points of all walks in one pass.
    """
    require_columns(df, [*row_id, *features])
    data = df.select(*row_id, *[F.col(c).cast("double").alias(c) for c in features])
    background = (data.orderBy(F.xxhash64(*row_id, F.lit(seed)), *row_id).limit(background_rows)
                  .select(F.array(*features).alias("__b")))  # a short list on the driver
    pool = F.array(*[F.array(*[F.lit(v) for v in r["__b"]]) for r in background.collect()])
    order = F.transform(F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(len(features) - 1)),
        lambda j: F.struct(F.xxhash64(*row_id, "perm", j, F.lit(seed)).alias("h"), j.alias("j")))),
        lambda s: s["j"])
    walks = (data.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
                 .withColumn("__order", order)
                 .withColumn("__from", F.get(pool, F.pmod(
                     F.xxhash64(*row_id, "perm", F.lit(seed + 1)), F.size(pool)).cast("int")))
                 .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(features))))))
    points = walks.withColumns({c: F.when(F.array_position("__order", j) <= F.col("step"), F.col(c))
                                .otherwise(F.get("__from", F.lit(j))) for j, c in enumerate(features)})
    scored = predict(points)
    walk = Window.partitionBy(*row_id, "perm").orderBy("step")  # len(features) + 1 rows
    gains = scored.withColumn("__gain", F.col("output") - F.lag("output", 1).over(walk)).filter("step > 0")
    names = F.array(*[F.lit(c) for c in features])
    return gains.withColumn("feature", F.get(names, F.get("__order", F.col("step") - 1))).groupBy(
        *row_id, "feature").agg(F.avg("__gain").alias("contribution"))


def local_surrogate(df: DataFrame, row_id: Sequence[str], features: Sequence[str], predict: Predict,
                    perturbations: int = PERTURBATIONS, width: float | None = None,
                    seed: int = SEED) -> DataFrame:
    """(row_id, feature, weight): a weighted linear fit around each row (local surrogate).

    Features move by hashed normal steps of one standard deviation. All rows are perturbed and
    scored together; each row's fit is a few aggregated sums.
    """
    require_columns(df, [*row_id, *features])
    data = df.select(*row_id, *[F.col(c).cast("double").alias(c) for c in features])
    spread = data.agg(*[F.stddev_pop(c).alias(c) for c in features]).first().asDict()
    width = width or 0.75 * len(features) ** 0.5
    many = data.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(perturbations))))

    def normal(j: int) -> Column:
        u = F.greatest(_uniform(*[F.col(c) for c in row_id], F.col("draw"), j, seed), F.lit(1e-6))
        v = _uniform(*[F.col(c) for c in row_id], F.col("draw"), j, seed + 1)
        return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v)

    stepped = many.withColumns({f"__z{j}": normal(j) for j in range(len(features))})
    moved = stepped.withColumns({c: F.col(c) + F.col(f"__z{j}") * F.lit(spread[c] or 0.0)
                                 for j, c in enumerate(features)})
    distance = sum((F.col(f"__z{j}") * F.col(f"__z{j}") for j in range(len(features))), F.lit(0.0))
    scored = predict(moved).withColumn("__w", F.exp(-distance / (width * width)))
    fits = fit_groups(scored, [f"__z{j}" for j in range(len(features))], "output", row_id, weight="__w",
                      ridge=1e-6)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.get("beta", F.lit(j + 1)).alias("weight"))
                      for j, c in enumerate(features)])
    return fits.select(*row_id, F.explode(parts).alias("p")).select(*row_id, "p.*")


def permutation_importance(df: DataFrame, features: Sequence[str], row_id: Sequence[str], predict: Predict,
                           score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(feature, metric, drop): loss of each metric when a feature is shuffled between rows."""
    from ..operators.ordered import number_rows

    base = score(predict(df)).withColumnRenamed("value", "__base")
    out = None
    placed = number_rows(df, [], row_id, "__rn")
    for j, c in enumerate(features):
        mixed = number_rows(df.select(F.col(c).alias("__c"), F.xxhash64(*row_id, F.lit(j)).alias("__h"), *row_id),
                            [], ["__h", *row_id], "__rn").select("__rn", "__c")
        shuffled = placed.join(mixed, "__rn").withColumn(c, F.col("__c")).drop("__rn", "__c")
        part = score(predict(shuffled)).join(base, "metric").select(
            F.lit(c).alias("feature"), "metric", (F.col("__base") - F.col("value")).alias("drop"))
        out = part if out is None else out.unionByName(part)
    return out


def report_lines(contributions: DataFrame) -> DataFrame:
    """(feature, line): the readable summary of global importance, one line per feature."""
    return global_importance(contributions).select("feature", F.format_string(
        "Feature '%s': mean(|contribution|) = %.4f", "feature", "importance").alias("line"))
