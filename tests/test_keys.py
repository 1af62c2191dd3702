"""Composite keys against every set of columns; the metric log with several writers."""

from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from grainmill.ml.evaluate import read_metrics, record_metrics
from grainmill.operators import keys


def brute(pdf, columns, size):
    out = []
    for n in range(1, size + 1):
        for s in combinations(columns, n):
            if not any(set(k) <= set(s) for k in out) and not pdf.duplicated(list(s)).any():
                out.append(s)
    return {tuple(s) for s in out}


@pytest.mark.parametrize("seed", [1])
def test_all_sets(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    pdf = pd.DataFrame({"a": rng.integers(0, 20, n), "b": np.arange(n) % 60, "c": rng.integers(0, 300, n), "d": np.arange(n) // 60,
                        "e": rng.integers(0, 2, n), "f": rng.integers(0, 40, n)})
    want = brute(pdf, list("abcdef"), 4)
    assert ("b", "d") in want and any(len(s) == 3 for s in want)
    got = keys.minimal_keys(spark.createDataFrame(pdf), max_size=4)
    assert {tuple(r["columns"]) for r in got.collect()} == want


def test_gaps_and_empty(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "x", 1.0)], "a long, b string, c double")
    assert [(r["columns"], r["n_rows"]) for r in keys.minimal_keys(df).collect()] == [(["a"], 2)]
    assert keys.minimal_keys(df.limit(0)).count() == 0


def test_writers_lose_nothing_and_reruns_add_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: record_metrics(spark, path, f"run/{k}", f"2024-01-0{k + 1} 00:00:00", {"acc": k / 10, "f1": k}), range(6)))
    assert read_metrics(spark, path).count() == 12
    record_metrics(spark, path, "run/3", "2024-01-04 00:00:00", {"acc": 0.3, "f1": 3})
    assert read_metrics(spark, path).count() == 12
    with pytest.raises(ValueError):
        record_metrics(spark, path, "run/3", "2024-01-04 00:00:00", {"acc": 0.9})
    with pytest.raises(ValueError):
        record_metrics(spark, path, "other", "2024-02-01 00:00:00", {"acc": 0.9}, expected_runs=5)
    record_metrics(spark, path, "other", "2024-02-01 00:00:00", {"acc": 0.9}, expected_runs=6)
    assert {r["run"] for r in read_metrics(spark, path).collect()} == {"other", *(f"run/{k}" for k in range(6))}
    assert spark.read.parquet(path).count() == 13
