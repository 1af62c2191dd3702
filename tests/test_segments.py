"""Optimal segmentation against an exhaustive program."""

import numpy as np
import pytest

from grainmill.operators.segments import Segmenter, optimal_changepoints, optimal_segments


def exhaustive(x, penalty, min_size, jump):
    """Ends of the best segments, by trying every last change of every beginning."""
    n = len(x)
    places = [0, *[k for k in range(jump, n, jump)], n]
    best, back = {0: 0.0}, {}
    for t in places[1:]:
        for s in places:
            if s in best and t - s >= min_size:
                cost = best[s] + ((x[s:t] - x[s:t].mean()) ** 2).sum() + penalty
                if t not in best or cost < best[t] - 1e-9:
                    best[t], back[t] = cost, s
    out, t = [], n
    while t:
        out.append(t)
        t = back[t]
    return out[::-1], best[n]


def total(x, ends, penalty):
    starts = [0, *ends[:-1]]
    return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + penalty for a, b in zip(starts, ends))


@pytest.mark.parametrize("min_size,jump", [(1, 1), (2, 1), (2, 5), (7, 1), (4, 3)])
def test_equals_the_exhaustive_program(min_size, jump):
    rng = np.random.default_rng(min_size * 10 + jump)
    for trial in range(25):
        n = int(rng.integers(max(8, min_size), 90))
        levels = rng.normal(size=12) * rng.choice([0.0, 1.0, 10.0])
        x = levels[np.sort(rng.integers(0, 12, n))] + rng.normal(size=n)
        penalty = float(rng.choice([0.5, 3.0, 20.0]))
        ends, cost = exhaustive(x, penalty, min_size, jump)
        whole = Segmenter(penalty, min_size, jump)
        whole.feed(x)
        got = whole.finish()
        assert np.isclose(total(x, [g[1] for g in got], penalty), cost)
        assert [g[1] for g in got] == ends
        assert got[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:]))
        parts, found, at = Segmenter(penalty, min_size, jump), [], 0
        while at < n:  # the same in stretches, each continued from its written state
            step = int(rng.integers(1, 20))
            parts.feed(x[at:at + step])
            at += step
            text = parts.dump()
            found += parts.take()
            parts = Segmenter.load(text)
        assert found + parts.finish() == got


def test_few_candidates_without_a_change():
    x = np.random.default_rng(1).normal(size=20_000)
    work = Segmenter(50.0, 1, 1)
    work.feed(x)
    assert len(work.at) < 60
    assert len(work.finish()) == 1


def test_constant_and_short_series():
    for x in ([], [1.0], [3.0] * 40, [1.0, 5.0, 9.0]):
        work = Segmenter(1.0, 2, 1)
        work.feed(np.array(x))
        assert sum(g[1] - g[0] + 1 for g in work.finish()) == len(x)


def test_powers_of_ten_end_at_once(spark):
    df = spark.createDataFrame([(k, 10.0 ** k) for k in range(75)], "t long, v double")
    found = optimal_changepoints(df, "v", [], ["t"], penalty=1.0, min_size=1, jump=1)
    assert {r.position for r in found.collect()} >= set(range(3, 70))


def test_series_in_rounds_with_null_keys(spark, tiny_limits):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for key in ("a", "b", None):
        n = {"a": 230, "b": 30, None: 120}[key]
        x = rng.normal(size=n) + np.repeat(rng.normal(size=10) * 8, n // 10)
        x = x.round(6)
        ends, _ = exhaustive(x, 12.0, 2, 1)
        starts = [0, *ends[:-1]]
        want |= {(key, a + 1, b, round(float(x[a:b].mean()), 6)) for a, b in zip(starts, ends)}
        rows += [(key, t, float(v)) for t, v in enumerate(x)] + [(key, 1000 + n, None), (key, 1001 + n, float("nan"))]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(3)
    got = optimal_segments(df, "v", ["k"], ["t"], 12.0, 2, 1)
    assert {(r.k, r.first, r.last, round(r.level, 6)) for r in got.collect()} == want
    assert optimal_segments(df.limit(0), "v", ["k"], ["t"]).count() == 0
