"""Unit-root and stationarity tests against one least-squares fit for every number of lags."""

from math import ceil, log, sqrt

import numpy as np
import pytest

from grainmill.operators.stationarity import adf_pvalue, adf_test, kpss_test


def fit(y, lags, skip, trend):
    """(squared error, t of the level, rows) of the model with `lags` differences on rows from `skip` on."""
    d = np.diff(y)
    rows = range(skip + 1, len(y))
    x = np.array([[1.0, *([float(t)] if trend else []), *(d[t - 1 - j] for j in range(1, lags + 1)), y[t - 1]] for t in rows])
    target = np.array([d[t - 1] for t in rows])
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    rest = ((target - x @ beta) ** 2).sum()
    inverse = np.linalg.inv(x.T @ x)
    return rest, beta[-1] / sqrt(rest / (len(x) - x.shape[1]) * inverse[-1, -1]), len(x)


def slow_adf(y, trend):
    most = min(ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - (2 if trend else 1) - 1)
    scores = []
    for lags in range(most + 1):
        rest, _, n = fit(y, lags, most, trend)
        scores.append((n * log(rest / n) + 2 * (lags + 2 + trend), lags))
    lags = min(scores)[1]
    _, t, n = fit(y, lags, lags, trend)
    return lags, n, t


def slow_kpss(y, trend):
    n = len(y)
    t = np.arange(n)
    e = y - (np.polyval(np.polyfit(t, y, 1), t) if trend else y.mean())
    s0, s1 = (e @ e) / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        p = e[k:] @ e[:-k] / (n / 2)
        s0, s1 = s0 + p, s1 + k * p
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    spread = e @ e + sum(2 * (e[k:] @ e[:-k]) * (1 - k / (lags + 1)) for k in range(1, lags + 1))
    return lags, (np.cumsum(e) ** 2).sum() / n ** 2 / (spread / n)


def series():
    rng = np.random.default_rng(12)
    noise = rng.normal(size=400)
    ar = np.zeros(300)
    for t in range(3, 300):
        ar[t] = 0.5 * ar[t - 1] - 0.4 * ar[t - 3] + noise[t]
    return {"white": noise[:250], "walk": 1000 + noise.cumsum(), "ar": ar, "trend": np.arange(120) * 0.3 + noise[:120], None: noise[:23].cumsum()}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("regression", ["c", "ct"])
def test_every_lag_is_fitted(spark, request, small, regression):
    if small:
        request.getfixturevalue("tiny_limits")
    data = {k: v.round(9) for k, v in series().items()}
    rows = [(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)]
    rows += [("white", 900, None), ("short", 0, 1.0), ("short", 1, 2.0), *(("flat", t, 0.1) for t in range(50))]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(3)
    adf = {r.k: r for r in adf_test(df, "v", ["k"], ["t"], regression).collect()}
    kpss = {r.k: r for r in kpss_test(df, "v", ["k"], ["t"], regression).collect()}
    for k, y in data.items():
        lags, n, t = slow_adf(y, regression == "ct")
        assert (adf[k].n, adf[k].n_lags, adf[k].n_obs) == (len(y), lags, n)
        assert np.isclose(adf[k].statistic, t, rtol=1e-6)
        lags, statistic = slow_kpss(y, regression == "ct")
        assert kpss[k].n_lags == lags and np.isclose(kpss[k].statistic, statistic, rtol=1e-7)
    assert adf["white"].stationary and kpss["white"].stationary
    assert not adf["walk"].stationary and not kpss["walk"].stationary
    assert adf["short"].statistic is None and adf["flat"].statistic is None and kpss["flat"].statistic is None
    assert adf_test(df.limit(0), "v", ["k"], ["t"]).count() == 0


def test_given_lags_and_no_key(spark):
    y = series()["ar"]
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "t long, v double")
    row = adf_test(df, "v", [], ["t"], max_lags=0).first()
    assert row.n_lags == 0 and np.isclose(row.statistic, fit(y, 0, 0, False)[1])
    assert kpss_test(df, "v", [], ["t"], lags=4).first().n_lags == 4


def test_published_points():
    # the 5 and 1 per cent points for long series
    assert abs(adf_pvalue(-2.8615, "c") - 0.05) < 0.002 and abs(adf_pvalue(-3.9588, "ct") - 0.01) < 0.002
