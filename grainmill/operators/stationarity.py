"""Stationarity tests with lags chosen per series: Dickey-Fuller by AIC, KPSS by its data-dependent bandwidth.

Every series is cut into blocks of `grainmill.maxGroupRows` rows, each lent the few rows before it that its lags
reach. A block yields small sums (cross products, lag products), the sums of a series are added up, and one row a
series is solved. For Dickey-Fuller one cross-product matrix of the largest model holds all smaller models: after each
step of its Cholesky factorisation stands the squared error of one more lag.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import MAX_GROUP_ROWS, setting
from .joins import join_groups
from .ordered import number_rows

# Published response surfaces of the Dickey-Fuller test (constant; constant and trend), as
# coefficients of 1, 1/T, 1/T^2, 1/T^3 at 1, 5 and 10 per cent.
ADF_CRITICAL = {
    "c": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    "ct": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
}
# Published approximations of its p-value: smallest, dividing and largest statistic, then the
# polynomials below and above the division, lowest power first.
ADF_P = {
    "c": (-18.83, -1.61, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (-16.18, -2.89, 0.7, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}
# Published critical values of the KPSS test at these levels.
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def adf_pvalue(statistic: float, regression: str) -> float:
    least, middle, most, small, large = ADF_P[regression]
    if statistic > most:
        return 1.0
    if statistic < least:
        return 0.0
    z = sum(c * statistic ** i for i, c in enumerate(small if statistic <= middle else large))
    return 0.5 * (1 + erf(z / sqrt(2)))


def most_lags(n: int, regression: str) -> int:
    """Largest number of lagged differences to look at for `n` values; negative if there are too few."""
    return min(ceil(12 * (n / 100) ** 0.25), n // 2 - len(regression) - 1)


class _Series:
    """Numbered values of many series, in blocks that are lent what lies `back` rows before."""

    def __init__(self, df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str], regression: str):
        if regression not in ADF_CRITICAL:
            raise ValueError(f"regression is one of {sorted(ADF_CRITICAL)}")
        self.keys = list(keys)
        self.names = [f"__k{i}" for i in range(max(1, len(self.keys)))]
        self.limit = setting(df.sparkSession, MAX_GROUP_ROWS)
        v = F.col(value).cast("double")
        numbered = number_rows(df.filter(v.isNotNull() & ~F.isnan(v)), keys, order_by, "__t")
        own = [F.col(k).alias(n) for k, n in zip(self.keys, self.names)] or [F.lit(0).alias("__k0")]
        rows = numbered.select(*own, "__t", v.alias("__v"))
        t = F.col("__t").cast("double")
        sums = rows.groupBy(*self.names).agg(
            F.count(F.lit(1)).alias("__n"), F.avg("__v").alias("__mean"),
            F.coalesce(F.try_divide(F.covar_pop("__v", t), F.var_pop(t)), F.lit(0.0)).alias("__slope"))
        self.longest = sums.agg(F.max("__n")).first()[0] or 0
        self.rows = join_groups(rows, sums, self.names, size="__n")
        self.kinds = dict(self.rows.dtypes)

    def added(self, rows: DataFrame, back: int, sums: Callable[[np.ndarray, int, int, dict], np.ndarray]) -> DataFrame:
        """(keys, block, sums) of each block; `sums` sees the values, how many are lent, the first own row's number,
        and the columns of the series."""
        if self.longest > self.limit:
            size = max(self.limit, back)
            home = F.floor((F.col("__t") - 1) / size)
            lent = F.when((F.col("__t") - 1) % size >= size - back, home + 1)
            rows = rows.withColumn("__home", home).withColumn("__block", F.explode(F.array_compact(F.array(home, lent))))
        else:
            rows = rows.withColumns({"__home": F.lit(0).cast("bigint"), "__block": F.lit(0).cast("bigint")})
        facts = [c for c in rows.columns if c not in (*self.names, "__t", "__v", "__home", "__block")]

        names = self.names

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("__t")
            own = table["__home"].to_numpy() == table["__block"].to_numpy()
            before = int(np.count_nonzero(~own))
            made = sums(table["__v"].to_numpy(), before, int(table["__t"][before].as_py()) if own.any() else 0,
                        {f: table[f][0].as_py() for f in facts}) if own.any() else np.zeros(0)
            return pa.table({**{k: table[k].combine_chunks().slice(0, 1) for k in names},
                             "__block": table["__block"].combine_chunks().slice(0, 1),
                             **{f: table[f].combine_chunks().slice(0, 1) for f in facts},
                             "__sums": pa.array([made.tolist()], pa.list_(pa.float64()))})

        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in [*self.names, "__block", *facts]) + ", __sums array<double>"
        return rows.groupBy(*self.names, "__block").applyInArrow(run, schema).filter(F.size("__sums") > 0)

    def solved(self, blocks: DataFrame, fields: dict[str, str], solve: Callable[[list[np.ndarray], dict], dict]) -> DataFrame:
        """(keys, fields): one row a series from the sums of its blocks, in order."""
        facts = [c for c in blocks.columns if c not in (*self.names, "__block", "__sums")]
        kinds = dict(blocks.dtypes)
        arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

        names = self.names

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("__block")
            made = solve([np.array(x.as_py(), float) for x in table["__sums"]], {f: table[f][0].as_py() for f in facts})
            return pa.table({**{k: table[k].combine_chunks().slice(0, 1) for k in names},
                             **{f: pa.array([made.get(f)], arrow[t]) for f, t in fields.items()}})

        schema = ", ".join([*(f"{k} {kinds[k]}" for k in self.names), *(f"{f} {t}" for f, t in fields.items())])
        return blocks.groupBy(*self.names).applyInArrow(run, schema)

    def named(self, out: DataFrame, fields: Sequence[str]) -> DataFrame:
        return out.select(*[F.col(n).alias(k) for k, n in zip(self.keys, self.names)], *fields)


def _design(values: np.ndarray, numbers: np.ndarray, mean: float, n: int, lags: int, regression: str) -> np.ndarray:
    """Rows (1, trend, value before, lagged differences, difference) of each value with `lags` + 1 others before it."""
    y = values - mean  # the level's coefficient is the same, and the sums keep their digits
    d = np.diff(y)
    m = len(y) - lags - 1
    if m <= 0:
        return np.zeros((0, len(regression) + lags + 2))
    columns = [np.ones(m)] + ([numbers[lags + 1:] / n - 0.5] if regression == "ct" else [])
    columns.append(y[lags:-1])
    columns += [d[lags - j:len(d) - j] for j in range(1, lags + 1)]
    return np.stack([*columns, d[lags:]], axis=1)


def adf_test(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str], regression: str = "c",
             max_lags: int | None = None) -> DataFrame:
    """(keys, n, n_lags, n_obs, statistic, pvalue, crit_1, crit_5, crit_10, stationary): augmented Dickey-Fuller test.

    `regression` is 'c' (constant) or 'ct' (constant and trend). The number of lagged differences with the least AIC
    is chosen among 0 to `max_lags` (by default a number that grows with the fourth root of the series) on the rows that
    have all lags; the chosen model is then fitted to all of its own rows. A series that is too short or constant has
    NULLs. NULL and NaN values are left out.
    """
    series = _Series(df, value, keys, order_by, regression)
    lead = len(regression)  # columns before the level

    def lags_of(n: int) -> int:
        most = most_lags(n, regression)
        return most if max_lags is None else min(max_lags, most)

    back = max(lags_of(series.longest), 0) + 1

    def products(values: np.ndarray, lent: int, first: int, facts: dict) -> np.ndarray:
        lags = lags_of(facts["__n"])
        if lags < 0:
            return np.zeros(1)
        start = max(0, lent - lags - 1)
        numbers = np.arange(first - lent + start, first - lent + len(values), dtype=float)
        width = lead + lags + 2
        total = np.zeros((width, width))
        part = values[start:]
        for a in range(0, max(len(part) - lags - 1, 0), 1 << 15):
            rows = _design(part[a:a + (1 << 15) + lags + 1], numbers[a:a + (1 << 15) + lags + 1], facts["__mean"],
                           facts["__n"], lags, regression)
            total += rows.T @ rows
        head = values[:2 * lags + 2] if first == 1 else np.zeros(0)  # rows that only smaller models have
        return np.concatenate((total.ravel(), head))

    def solve(parts: list[np.ndarray], facts: dict) -> dict:
        n = facts["__n"]
        lags = lags_of(n)
        out = {"n": n}
        if lags < 0:
            return out
        width = lead + lags + 2
        total = sum(p[:width * width] for p in parts).reshape(width, width)
        head = np.concatenate([p[width * width:] for p in parts])
        obs = n - lags - 1
        errors = nested_errors(total)
        if errors is None:
            return out
        aic = [obs * log(errors[lead + 1 + p] / obs) + 2 * (lead + 1 + p) if errors[lead + 1 + p] > 0 else -np.inf
               for p in range(lags + 1)]
        chosen = int(np.argmin(aic))
        # Columns of the chosen model, the level last; its rows before the first one of the largest model are added.
        keep = [*range(lead), *range(lead + 1, lead + 1 + chosen), lead]
        early = head[:lags + 1]
        rows = _design(early, np.arange(1, len(early) + 1, dtype=float), facts["__mean"], n, chosen, regression)
        order = [*range(lead), *range(lead + 1, lead + 1 + chosen), lead, rows.shape[1] - 1]
        full = total[np.ix_([*keep, width - 1], [*keep, width - 1])] + rows[:, order].T @ rows[:, order]
        factor = cholesky(full[:-1, :-1])
        if factor is None:
            return out
        obs, z = n - chosen - 1, np.linalg.solve(factor, full[:-1, -1])
        rest = full[-1, -1] - z @ z
        spread = rest / (obs - len(keep)) if obs > len(keep) else 0.0
        if spread <= 0:
            return out
        statistic = float(z[-1] / sqrt(spread))
        crit = [sum(c / obs ** i for i, c in enumerate(row)) for row in ADF_CRITICAL[regression]]
        p = adf_pvalue(statistic, regression)
        return out | {"n_lags": chosen, "n_obs": obs, "statistic": statistic, "pvalue": p, "crit_1": crit[0],
                      "crit_5": crit[1], "crit_10": crit[2], "stationary": p < 0.05}

    fields = {"n": "bigint", "n_lags": "bigint", "n_obs": "bigint", "statistic": "double", "pvalue": "double",
              "crit_1": "double", "crit_5": "double", "crit_10": "double", "stationary": "boolean"}
    out = series.solved(series.added(series.rows, back, products), fields, solve)
    return series.named(out, list(fields))


def cholesky(matrix: np.ndarray) -> np.ndarray | None:
    """Lower factor, scaled inside so that wide ranges of values do no harm; None if the matrix is not definite."""
    scale = np.sqrt(np.diag(matrix))
    if not (scale > 0).all():
        return None
    try:
        factor = np.linalg.cholesky(matrix / np.outer(scale, scale))
    except np.linalg.LinAlgError:
        return None
    if np.diag(factor).min() < 1e-7:
        return None
    return factor * scale[:, None]


def nested_errors(products: np.ndarray) -> np.ndarray | None:
    """Squared errors of the last column fitted by the first 0, 1, 2, ... others, from all cross products."""
    factor = cholesky(products[:-1, :-1])
    if factor is None:
        return None
    z = np.linalg.solve(factor, products[:-1, -1])
    return products[-1, -1] - np.concatenate(([0.0], np.cumsum(z * z)))


def kpss_test(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str], regression: str = "c",
              lags: int | None = None) -> DataFrame:
    """(keys, n, n_lags, statistic, pvalue, crit_10, crit_5, crit_2_5, crit_1, stationary): KPSS test.

    `regression` is 'c' (level) or 'ct' (trend). Without `lags` the bandwidth of the Bartlett weights follows from the
    first autocovariances of each series. p-values lie between 0.01 and 0.1, the ends of the published table. Constant
    series have NULLs. NULL and NaN values are left out.
    """
    series = _Series(df, value, keys, order_by, regression)

    def residuals(values: np.ndarray, first: int, facts: dict) -> np.ndarray:
        if regression == "c":
            return values - facts["__mean"]
        numbers = np.arange(first, first + len(values), dtype=float)
        return values - facts["__mean"] - facts["__slope"] * (numbers - (facts["__n"] + 1) / 2)

    def lag_sums(values: np.ndarray, lent: int, first: int, facts: dict, most: int) -> np.ndarray:
        """Products of the own residuals with those 0 to `most` rows before."""
        e = residuals(values, first - lent, facts)
        out = np.zeros(most + 1)
        for k in range(min(most, len(e) - 1) + 1):
            start = max(lent, k)
            out[k] = e[start:] @ e[start - k:len(e) - k]
        return out

    rows = series.rows
    if lags is None:
        reach = int(series.longest ** (2 / 9))

        def near(values: np.ndarray, lent: int, first: int, facts: dict) -> np.ndarray:
            return lag_sums(values, lent, first, facts, int(facts["__n"] ** (2 / 9)))

        def bandwidth(parts: list[np.ndarray], facts: dict) -> dict:
            n, total = facts["__n"], sum(parts)
            level = total[0] / n + sum(total[1:]) / (n / 2)
            slope = sum(k * x for k, x in enumerate(total)) / (n / 2)
            if not level:
                return {"__lags": 0}
            return {"__lags": max(0, min(int(1.1447 * ((slope / level) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1))}

        chosen = series.solved(series.added(rows, reach, near), {"__lags": "bigint"}, bandwidth)
        rows = join_groups(rows, chosen, series.names)
        most = rows.agg(F.max("__lags")).first()[0] or 0
    else:
        rows = rows.withColumn("__lags", F.least(F.lit(lags).cast("bigint"), F.col("__n") - 1))
        most = lags

    def block(values: np.ndarray, lent: int, first: int, facts: dict) -> np.ndarray:
        e = residuals(values, first - lent, facts)[lent:]
        run = np.cumsum(e)
        return np.concatenate(([len(e), run[-1], run.sum(), run @ run],
                               lag_sums(values, lent, first, facts, facts["__lags"])))

    def solve(parts: list[np.ndarray], facts: dict) -> dict:
        n, before, squares = facts["__n"], 0.0, 0.0
        for count, end, total, square in (p[:4] for p in parts):
            squares += square + 2 * before * total + count * before * before
            before += end
        products = sum(p[4:] for p in parts)
        weights = 1 - np.arange(1, len(products)) / len(products)
        spread = (products[0] + 2 * (weights @ products[1:])) / n
        out = {"n": n, "n_lags": facts["__lags"]}
        if spread <= 1e-24 * facts["__mean"] ** 2:  # constant but for rounding
            return out
        statistic = float(squares / n / n / spread)
        crit = KPSS_CRITICAL[regression]
        p = float(np.interp(statistic, crit, KPSS_LEVELS))
        return out | {"statistic": statistic, "pvalue": p, "crit_10": crit[0], "crit_5": crit[1], "crit_2_5": crit[2],
                      "crit_1": crit[3], "stationary": p > 0.05}

    fields = {"n": "bigint", "n_lags": "bigint", "statistic": "double", "pvalue": "double", "crit_10": "double",
              "crit_5": "double", "crit_2_5": "double", "crit_1": "double", "stationary": "boolean"}
    return series.named(series.solved(series.added(rows, most, block), fields, solve), list(fields))
