"""The k-d search with many small leaves, gaps and crowds, against brute force."""

import time

import numpy as np
import pandas as pd
import pytest

from grainmill.operators import kdsearch
from grainmill.operators.neighbors import knn_impute, nearest


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(kdsearch, "LEAF_ROWS", 16)
    monkeypatch.setattr(kdsearch, "VISITORS", 40)
    monkeypatch.setattr(kdsearch, "SAMPLE_ROWS", 120)


def brute_fill(x, k):
    want = x.copy()
    for i, c in zip(*np.nonzero(np.isnan(x))):
        both = ~np.isnan(x) & ~np.isnan(x[i])
        common = both.sum(axis=1)
        gap = np.where(both, x - x[i], 0.0)
        d = np.where(common > 0, np.sqrt(x.shape[1] / np.maximum(common, 1) * (gap * gap).sum(axis=1)), np.inf)
        d[np.isnan(x[:, c])] = np.inf
        near = [j for j in np.lexsort((np.arange(len(x)), d.round(12)))[:k] if np.isfinite(d[j])]
        want[i, c] = x[near, c].mean() if near else np.nanmean(x[:, c])
    return want


def gappy(n, d, share, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(9)
    x[: n // 3] = x[0]                                    # a third of the rows are copies
    x[n // 3: n // 2, 0] = 5.0                            # and one column is often the same
    x[rng.random(x.shape) < share] = np.nan
    return x


@pytest.mark.parametrize("n,d,share", [(1000, 4, 0.2), (300, 7, 0.4), (200, 1, 0.3)])
def test_any_pattern_of_gaps(spark, small_leaves, n, d, share):
    x = gappy(n, d, share)
    names = [f"c{j}" for j in range(d)]
    pdf = pd.DataFrame(x, columns=names).assign(id=range(n))
    got = knn_impute(spark.createDataFrame(pdf).repartition(3), names, ["id"], 3).toPandas().sort_values("id")
    assert np.allclose(got[names], brute_fill(x, 3))


def test_a_thousand_gappy_rows_take_seconds(spark):
    x = gappy(1000, 4, 0.2, 9)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=range(1000))
    df = spark.createDataFrame(pdf)
    start = time.time()
    got = knn_impute(df, list("abcd"), ["id"], 3).toPandas().sort_values("id")
    assert time.time() - start < 60
    assert np.allclose(got[list("abcd")], brute_fill(x, 3))


def jobs(spark, run):
    group = f"count-{time.time()}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    spark.sparkContext.setJobGroup("after", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_patterns(spark):
    def frame(d, share):
        x = gappy(200, d, share)
        return spark.createDataFrame(pd.DataFrame(x, columns=[f"c{j}" for j in range(d)]).assign(id=range(200))).cache()
    few, many = frame(2, 0.1), frame(6, 0.4)
    counts = [jobs(spark, lambda f=f: knn_impute(f, [c for c in f.columns if c != "id"], ["id"], 3).count()) for f in (few, many)]
    assert abs(counts[0] - counts[1]) <= 6


@pytest.mark.parametrize("d", [1, 3, 8])
def test_nearest_with_small_leaves(spark, small_leaves, d):
    rng = np.random.default_rng(d)
    x = np.unique(np.vstack([rng.normal(size=(150, d)), rng.normal(size=(150, d)) * 1e-4 + 7]).round(6), axis=0)
    names = [f"x{j}" for j in range(d)]
    points = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(p=range(len(x)), w=1))
    queries = spark.createDataFrame(pd.DataFrame(rng.normal(size=(60, d)) * 3, columns=names).assign(q=range(60)))
    got = nearest(queries, points, names, 5).toPandas()
    q = queries.toPandas()
    for number, part in got.groupby("q"):
        dist = np.sqrt(((x - q.loc[q["q"] == number, names].to_numpy()) ** 2).sum(axis=1))
        assert np.allclose(np.sort(part["dist"]), np.sort(dist)[:5])


def test_no_rows_and_no_gaps(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "id long, a double, b double")
    assert knn_impute(df, ["a", "b"], ["id"]).count() == 2
    assert knn_impute(df.limit(0), ["a", "b"], ["id"]).count() == 0
    alone = spark.createDataFrame([(1, None, 2.0), (2, 3.0, None)], "id long, a double, b double")
    assert {tuple(r) for r in knn_impute(alone, ["a", "b"], ["id"]).collect()} == {(1, 3.0, 2.0), (2, 3.0, 2.0)}
