"""Correlation and association between columns, in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import join_groups
from .ordered import running_totals
from .profile import numeric_columns, text_columns
from .quantiles import as_double

PAIRS_PER_PASS = 60
PAIR_SCHEMA = "c1 string, c2 string, r double"
MULTICOLLINEAR_AT = 0.8   # fixed value
TOP_DEPENDENCIES = 20     # fixed value
CELLS_PER_TASK, MOST_BLOCKS = 500_000, 512  # Kendall: cells a task takes, blocks an axis is cut into


def _columns(df: DataFrame, columns: Sequence[str] | None, ignore: Sequence[str]) -> list[str]:
    return [c for c in (columns or numeric_columns(df)) if c not in set(ignore)]


def pearson(df: DataFrame, columns: Sequence[str] | None = None,
            ignore: Sequence[str] = ()) -> DataFrame:
    """(c1, c2, r) for c1 before c2, pairwise complete; null where a column is constant.

    All pairs of a batch come out of one pre-aggregated scan.
    """
    columns = _columns(df, columns, ignore)
    values = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2))
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        group = pairs[start:start + PAIRS_PER_PASS]
        aggregates = []
        for i, j in group:
            a, b = F.col(f"v{i}"), F.col(f"v{j}")
            both = a.isNotNull() & b.isNotNull()
            sd = F.stddev_samp(F.when(both, a)) * F.stddev_samp(F.when(both, b))
            aggregates.append(F.try_divide(F.covar_samp(a, b), sd).alias(f"r_{i}_{j}"))
        rows = F.array(*[F.struct(F.lit(columns[i]).alias("c1"), F.lit(columns[j]).alias("c2"),
                                  F.col(f"r_{i}_{j}").alias("r")) for i, j in group])
        parts.append(values.agg(*aggregates).select(F.explode(rows).alias("p")).select("p.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its average rank.

    Ranks come from value counts (combined before the shuffle) and running totals over the
    distinct values, then join back to the rows.
    """
    out = df.select(*[as_double(df, c).alias(c) for c in columns])
    source = out
    for c in columns:
        counts = cut_lineage(source.filter(F.col(c).isNotNull()).groupBy(c)
                             .agg(F.count(F.lit(1)).alias("__n")))
        below = running_totals(counts, [], [c], {"__below": F.col("__n")}, inclusive=False)
        ranks = below.select(c, "__n", (F.col("__below") + (F.col("__n") + 1) / 2).alias("__rank"))
        out = (join_groups(out, ranks, [c], size="__n")
               .withColumn(c, F.col("__rank")).drop("__rank", "__n"))
    return out


def spearman(df: DataFrame, columns: Sequence[str] | None = None,
             ignore: Sequence[str] = ()) -> DataFrame:
    """Pearson on average ranks; ranks are taken within each pair's complete rows."""
    columns = _columns(df, columns, ignore)
    values = df.select(*[as_double(df, c).alias(c) for c in columns])
    nulls = values.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    gaps = [c for c in columns if nulls[c]]
    whole = [c for c in columns if not nulls[c]]
    out = pearson(average_ranks(values, whole), whole) if len(whole) > 1 else (
        df.sparkSession.createDataFrame([], PAIR_SCHEMA))
    for a, b in combinations(columns, 2):
        if a in gaps or b in gaps:
            pair = values.select(a, b).dropna()
            out = out.unionByName(pearson(average_ranks(pair, [a, b]), [a, b]))
    return out


def discordant(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Weight of the pairs of cells in which x grows and y falls.

    On the dense ranks of y the highest bit that differs decides. So for each bit, and each prefix above it, a running
    total over x of the cells with bit 1 is what the cells with bit 0 meet: n log n work.
    """
    rank = np.unique(y, return_inverse=True)[1]
    total = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        prefix, one = rank >> (bit + 1), (rank >> bit) & 1
        order = np.lexsort((x, prefix))
        ones = np.where(one[order] == 1, n[order], 0.0)
        before = np.cumsum(ones) - ones
        new_prefix = np.append(True, prefix[order][1:] != prefix[order][:-1])
        new_x = new_prefix | np.append(True, x[order][1:] != x[order][:-1])
        met = before[np.flatnonzero(new_x)[np.cumsum(new_x) - 1]] - before[np.flatnonzero(new_prefix)[np.cumsum(new_prefix) - 1]]
        total += float(((n[order] - ones) * met).sum())
    return total


def crossing(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The same for the cells of a table of blocks."""
    ranks = [np.unique(v, return_inverse=True)[1] for v in (x, y)]
    grid = np.zeros([int(r.max(initial=0)) + 1 for r in ranks])
    np.add.at(grid, tuple(ranks), n)
    lower = np.cumsum(grid, axis=0) - grid                          # smaller x, same y
    above = np.cumsum(lower[:, ::-1], axis=1)[:, ::-1] - lower      # and larger y
    return float((grid * above).sum())


def kendall(df: DataFrame, columns: Sequence[str] | None = None,
            ignore: Sequence[str] = ()) -> DataFrame:
    """(c1, c2, r): Kendall tau-b of all pairs of columns, pairwise complete, without comparing pairs of rows.

    The distinct cells of all pairs are counted in one pass. Where they are many, both axes are cut into blocks, a
    frequent value being a block of its own. Discordant pairs within a block of x or of y are counted block by block,
    those in both are counted once less, and those in different blocks on both axes follow from the numbers of rows per
    pair of blocks. The number of jobs does not depend on the number of columns.
    """
    columns = _columns(df, columns, ignore)
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    values = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"))
                     for k, (i, j) in enumerate(pairs)])
    cells = cut_lineage(values.select(F.explode(rows).alias("c")).select("c.*").dropna()
                        .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
    most = cells.groupBy("pair").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    if most <= CELLS_PER_TASK:
        met = cells.groupBy("pair").applyInArrow(_counter(discordant), "pair int, d double")
    else:
        blocks = min(MOST_BLOCKS, -(-most // CELLS_PER_TASK))
        shares = [k / blocks for k in range(1, blocks)] or [0.5]
        found = values.agg(*[F.percentile_approx(f"v{i}", F.array(*[F.lit(s) for s in shares]), 100 * blocks).alias(f"v{i}")
                             for i in range(len(columns))]).first()
        cuts = [sorted(set(found[f"v{i}"] or ())) for i in range(len(columns))]
        placed = cells.mapInArrow(partial(_blocks, pairs, cuts), "pair int, x double, y double, n double, xb int, yb int")
        placed = cut_lineage(placed)
        # Odd blocks hold one value: no pair of cells in them is discordant.
        ways = F.array_compact(F.array(
            F.when(F.col("xb") % 2 == 0, F.struct(F.lit(1.0).alias("sign"), F.col("xb").alias("a"), F.lit(-1).alias("b"))),
            F.when(F.col("yb") % 2 == 0, F.struct(F.lit(1.0).alias("sign"), F.lit(-1).alias("a"), F.col("yb").alias("b"))),
            F.when((F.col("xb") % 2 == 0) & (F.col("yb") % 2 == 0),
                   F.struct(F.lit(-1.0).alias("sign"), F.col("xb").alias("a"), F.col("yb").alias("b")))))
        inside = placed.select("pair", "x", "y", "n", F.explode(ways).alias("w")).select("pair", "x", "y", "n", "w.*")
        near = inside.groupBy("pair", "sign", "a", "b").applyInArrow(_counter(discordant, signed=True), "pair int, d double")
        table = placed.groupBy("pair", F.col("xb").cast("double").alias("x"), F.col("yb").cast("double").alias("y")).agg(F.sum("n").alias("n"))
        far = table.groupBy("pair").applyInArrow(_counter(crossing), "pair int, d double")
        met = near.unionByName(far)
    pairs_of = F.col("n") * (F.col("n") - 1) / 2
    sums = [met.groupBy("pair").agg(F.sum("d").alias("d")),
            cells.groupBy("pair").agg(F.sum(pairs_of).alias("txy"), F.sum("n").alias("t")),
            *[cells.groupBy("pair", side).agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum(pairs_of).alias(f"t{side}"))
              for side in ("x", "y")]]
    row = df.sparkSession.createDataFrame([(k, columns[i], columns[j]) for k, (i, j) in enumerate(pairs)], "pair int, c1 string, c2 string")
    for one in sums:  # one row a pair
        row = row.join(F.broadcast(one), "pair", "left")
    whole = F.col("t") * (F.col("t") - 1) / 2
    concordant = whole - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d")
    return row.select("c1", "c2", F.try_divide(
        concordant - F.col("d"), F.sqrt(whole - F.col("tx")) * F.sqrt(whole - F.col("ty"))).alias("r"))


def _counter(count: Callable, signed: bool = False) -> Callable:
    """A function from the cells of a group to (pair, d)."""
    def run(table: pa.Table) -> pa.Table:
        sign = table["sign"][0].as_py() if signed else 1.0
        d = sign * count(*(table[c].to_numpy() for c in ("x", "y", "n")))
        return pa.table({"pair": table["pair"].combine_chunks().slice(0, 1), "d": pa.array([d])})

    return run


def _blocks(pairs: Sequence[tuple[int, int]], cuts: Sequence[Sequence[float]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the block of x and y: odd for a value that is a cut, even for what lies between two cuts."""
    bounds = [np.array(c, float) for c in cuts]

    def block(column: int, v: np.ndarray) -> np.ndarray:
        left = np.searchsorted(bounds[column], v, "left")
        return (left + np.searchsorted(bounds[column], v, "right")).astype(np.int32)

    for batch in batches:
        pair, x, y = (batch.column(k).to_numpy() for k in range(3))
        placed = [np.zeros(len(pair), np.int32), np.zeros(len(pair), np.int32)]
        for k in np.unique(pair).tolist():
            own = pair == k
            for side, (column, v) in enumerate(zip(pairs[k], (x, y))):
                placed[side][own] = block(column, v[own])
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, placed)], [*batch.schema.names, "xb", "yb"])


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n) in long form; empty cells are left out."""
    return (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
              .groupBy(x, y).agg(F.count(F.lit(1)).alias("n")))


def cramers_v(df: DataFrame, columns: Sequence[str] | None = None,
              expected: str = "independence", ignore: Sequence[str] = ()) -> DataFrame:
    """(c1, c2, r): Cramer's V of every pair of text columns, all pairs in one scan.

    `expected="column_mean"` compares each cell with the mean of its column instead of the
    independence expectation. Both sums are written over filled cells only.
    """
    if expected not in ("independence", "column_mean"):
        raise ValueError("expected must be 'independence' or 'column_mean'")
    columns = [c for c in (columns or text_columns(df)) if c not in set(ignore)]
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    entries = F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"),
                                 F.col(a).cast("string").alias("x"),
                                 F.col(b).cast("string").alias("y")) for a, b in pairs])
    key = ["c1", "c2"]
    cells = (df.select(F.explode(entries).alias("e")).select("e.*").dropna()
               .groupBy(*key, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
    rows = cells.groupBy(*key, "x").agg(F.sum("n").alias("n_x"))
    cols = cells.groupBy(*key, "y").agg(F.sum("n").alias("n_y"))
    sizes = (cells.groupBy(*key).agg(F.sum("n").alias("t"))
             .join(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("r_x")), key)
             .join(cols.groupBy(*key).agg(F.count(F.lit(1)).alias("r_y")), key))
    square = F.col("n") * F.col("n")
    joined = cells.join(cols, [*key, "y"])
    if expected == "independence":
        joined = joined.join(rows, [*key, "x"])
        part = square / (F.col("n_x") * F.col("n_y"))
        chi2 = F.col("t") * (F.col("s") - 1)
    else:
        part = square / F.col("n_y")
        chi2 = F.col("r_x") * F.col("s") - F.col("t")
    sums = joined.groupBy(*key).agg(F.sum(part).alias("s"))
    freedom = F.least("r_x", "r_y") - 1
    value = F.sqrt(F.try_divide(F.greatest(chi2, F.lit(0.0)), F.col("t") * freedom))
    return sums.join(F.broadcast(sizes), key).select(*key, value.alias("r"))


def multicollinear(pairs: DataFrame, threshold: float = MULTICOLLINEAR_AT) -> DataFrame:
    """(feature, others): features with |r| at or above the threshold to others."""
    strong = pairs.filter(F.abs("r") >= threshold)
    both = strong.select(F.col("c1").alias("feature"), F.col("c2").alias("other")).unionAll(
        strong.select("c2", "c1"))
    return both.groupBy("feature").agg(F.array_sort(F.collect_list("other")).alias("others"))


def rank_dependencies(df: DataFrame, numeric: Sequence[str] | None = None,
                      categorical: Sequence[str] | None = None,
                      methods: Sequence[str] = ("pearson", "spearman", "kendall", "cramers_v"),
                      top: int = TOP_DEPENDENCIES) -> DataFrame:
    """(feature_1, feature_2, score, method): strongest absolute dependencies."""
    found = df.sparkSession.createDataFrame([], PAIR_SCHEMA + ", method string")
    for method in methods:
        if method == "cramers_v":
            part = cramers_v(df, categorical)
        else:
            part = {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method](df, numeric)
        found = found.unionByName(part.withColumn("method", F.lit(method)))
    return (found.filter("r is not null").select(
        F.col("c1").alias("feature_1"), F.col("c2").alias("feature_2"),
        F.round(F.abs("r"), 4).alias("score"), "method")
        .orderBy(F.desc("score"), "feature_1", "feature_2", "method").limit(top))
