"""Robust decomposition against local regression written out row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import stl


def slow_line(y, span, at, weights):
    n = len(y)
    width = min(span, n)
    start = min(max(at - (span - 1) // 2, 0), n - width)
    h = max(at - start, start + width - 1 - at) + max(0, (span - n) // 2)
    w = np.zeros(n)
    for j in range(start, start + width):
        d = abs(j - at)
        if d <= 0.999 * h:
            w[j] = (1.0 if d <= 0.001 * h else (1 - (d / h) ** 3) ** 3) * weights[j]
    if w.sum() <= 0:
        return y[min(max(at, 0), n - 1)]
    w /= w.sum()
    x = np.arange(n)
    a = (w * x).sum()
    c = (w * (x - a) ** 2).sum()
    if np.sqrt(c) > 0.001 * (n - 1):
        w = w * (1 + (at - a) / c * (x - a))
    return (w * y).sum()


def slow_mean(y, width):
    return np.array([y[k:k + width].mean() for k in range(len(y) - width + 1)])


def slow_stl(y, period, outer, inner):
    ns, nt, nl = stl.spans(period)
    n = len(y)
    trend, rw = np.zeros(n), np.ones(n)
    for k in range(outer + 1):
        for _ in range(inner):
            d = y - trend
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                sub, sw = d[phase::period], rw[phase::period]
                for i in range(-1, len(sub) + 1):
                    cycle[(i + 1) * period + phase] = slow_line(sub, ns, i, sw)
            slow = slow_mean(slow_mean(slow_mean(cycle, period), period), 3)
            low = np.array([slow_line(slow, nl, i, np.ones(n)) for i in range(n)])
            season = cycle[period:-period] - low
            trend = np.array([slow_line(y - season, nt, i, rw) for i in range(n)])
        if k < outer:
            r = np.abs(y - trend - season)
            h = 6 * np.median(r)
            rw = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0.0))
    return trend, season, rw


def invented(n, period, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 0.05 * t + 3 * np.sin(2 * np.pi * t / period) + rng.normal(size=n) * 0.3


@pytest.mark.parametrize("n,period,outer", [(60, 4, 0), (61, 7, 3), (40, 12, 2)])
def test_same_as_row_by_row(n, period, outer):
    y = invented(n, period)
    y[n // 2] += 30
    for got, want in zip(stl.fit_series(y, period, stl.spans(period), 2, outer), slow_stl(y, period, outer, 2)):
        assert np.allclose(got, want, atol=1e-9)


def test_outliers_leave_the_season_unchanged():
    y = invented(140, 7)
    hit = y.copy()
    hit[[20, 77, 78, 110]] += [40, -55, 60, 35]
    plain, robust = ([stl.fit_series(v, 7, stl.spans(7), 2, outer)[1] for v in (y, hit)] for outer in (0, 15))
    assert np.abs(plain[0] - plain[1]).max() > 3
    assert np.abs(robust[0] - robust[1]).max() < 0.5


def test_keys_gaps_and_short_series(spark):
    y = invented(70, 7)
    rows = [(k, t, float(v)) for k in ("a", None) for t, v in enumerate(y)] + [("short", t, 1.0) for t in range(13)]
    rows[30] = ("a", 30, None)
    df = spark.createDataFrame(rows, "k string, t long, v double").withColumn("trend", F.lit("old")).repartition(4)
    out = stl.stl_decompose(df, "v", 7, ["k"], ["t"])
    assert out.columns == ["k", "t", "v", "trend", "seasonal", "resid", "weight"]
    got = {(r.k, r.t): r for r in out.collect()}
    trend, season, weight = stl.fit_series(y, 7, stl.spans(7), 2, 15)
    assert len(got) == len(rows)
    for t in range(70):
        r = got[None, t]
        assert np.allclose([r.trend, r.seasonal, r.weight, r.resid], [trend[t], season[t], weight[t], y[t] - trend[t] - season[t]])
    assert got["a", 30].resid is None and abs(got["a", 30].trend - trend[30]) < 0.3
    assert got["short", 3].trend is None
    assert stl.stl_decompose(df.limit(0), "v", 7, ["k"], ["t"]).count() == 0


def test_cut_series_are_the_same(spark, tiny_limits):
    y = invented(1100, 4, 3)
    y[[50, 600]] += 40
    rows = [(t, float(v) if t not in (0, 7, 300, 301, 1099) else None) for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "t long, v double").repartition(3)
    out = {r.t: r for r in stl.stl_decompose(df, "v", 4, [], ["t"], outer=2).collect()}
    gaps = np.array([v if v is not None else np.nan for _, v in rows])
    trend, season, weight = stl.fit_series(gaps, 4, stl.spans(4), 2, 2)
    assert np.allclose([out[t].trend for t in range(1100)], trend, atol=1e-8)
    assert np.allclose([out[t].seasonal for t in range(1100)], season, atol=1e-8)
    assert np.allclose([out[t].weight for t in range(1100)], weight, atol=1e-6)


def test_anomalies(spark):
    y = invented(140, 7)
    y[77] += 50
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "t long, v double")
    found = stl.stl_anomalies(df, "v", 7, [], ["t"]).collect()
    assert [r.t for r in found] == [77] and found[0].zscore > 10
