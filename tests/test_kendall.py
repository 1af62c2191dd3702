"""Kendall tau of many columns at once against all pairs of rows."""

import time

import numpy as np
import pandas as pd
import pytest

from grainmill.operators import correlate


def brute(a, b):
    ok = ~np.isnan(a) & ~np.isnan(b)
    a, b = a[ok], b[ok]
    sx, sy = np.sign(a[:, None] - a[None]), np.sign(b[:, None] - b[None])
    s = (sx * sy).sum()
    x, y = (sx != 0).sum(), (sy != 0).sum()
    return s / np.sqrt(float(x) * float(y)) if x and y else None


def test_counts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.integers(0, 9, 40).astype(float), rng.integers(0, 13, 40).astype(float)
        n = rng.integers(1, 5, 40).astype(float)
        want = (n[:, None] * n[None] * ((x[:, None] < x[None]) & (y[:, None] > y[None]))).sum()
        assert correlate.discordant(x, y, n) == correlate.crossing(x, y, n) == want


@pytest.mark.parametrize("cells", [500_000, 40])
def test_all_pairs_of_columns(spark, monkeypatch, cells):
    monkeypatch.setattr(correlate, "CELLS_PER_TASK", cells)
    rng = np.random.default_rng(2)
    n = 400
    frame = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "d": np.ones(n)})
    frame["c"] = frame["a"] + rng.normal(size=n)
    frame["h"] = np.where(rng.random(n) < 0.4, 0.0, frame["c"])   # one value has a third of the rows and more
    frame.loc[rng.random(n) < 0.1, "a"] = np.nan
    names = list("abchd")
    got = {(r.c1, r.c2): r.r for r in correlate.kendall(spark.createDataFrame(frame).repartition(3), names).collect()}
    assert len(got) == 10
    for (x, y), r in got.items():
        want = brute(frame[x].to_numpy(), frame[y].to_numpy())
        assert (r is None) == (want is None) and (want is None or np.isclose(r, want)), (x, y)


def test_jobs_do_not_grow_with_the_columns(spark):
    rng = np.random.default_rng(3)
    counts = []
    for d in (2, 7):
        df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(50, d)), columns=[f"c{j}" for j in range(d)]))
        group = f"kendall-{d}-{time.time()}"
        spark.sparkContext.setJobGroup(group, "")
        assert correlate.kendall(df).count() == d * (d - 1) // 2
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("after", "")
    assert counts[0] == counts[1]
