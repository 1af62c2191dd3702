import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import gru, lm

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
                sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in rows}


def check(frame, rows):
    got, want = {r.doc_id: r for r in frame.collect()}, brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score < 0
    return got


def test_documents_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    got = check(lm.score_texts(docs), [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "One two THREE"), (4, "one two three four"), (None, "one"), (10, "é è ñ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("x"))
    check(lm.score_texts(docs), rows)
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    flat = gru.initial().astype(np.float64)
    given, target = rng.integers(0, gru.SYMBOLS, (5, 4)), rng.integers(0, gru.SYMBOLS, (5, 4))
    keep, weight = (rng.random((5, 4)) > 0.2).astype(float), np.ones((5, 4))

    def loss(f):
        p, h, out = gru.views(f), np.zeros((4, gru.STATE)), 0
        for t in range(5):
            h = gru.step(p, p["x"][given[t]], h * keep[t][:, None])[0]
            out -= gru.log_shares(p, h, target[t]).sum()
        return out / 20

    gradient = gru.window_gradient(gru.views(flat), given, target, keep, weight, np.zeros((4, gru.STATE)))[1]
    for k in rng.choice(np.flatnonzero(np.abs(gradient) > 1e-3), 25):
        e = np.zeros_like(flat)
        e[k] = 1e-5
        assert (loss(flat + e) - loss(flat - e)) / 2e-5 == pytest.approx(gradient[k], rel=2e-2)


def test_scores_match_one_text_at_a_time():
    rng, flat = np.random.default_rng(4), gru.initial()
    texts = [rng.integers(0, gru.SYMBOLS, n) for n in (1, 3, 200, 65, 64, 130)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = gru.score(flat, np.concatenate(texts), first, 7)
    for text, value in zip(texts, got):
        p, h, out, last = gru.views(flat), np.zeros((1, gru.STATE), np.float32), 0, 7
        for s in text:
            h = gru.step(p, p["x"][[last]], h)[0]
            out += gru.log_shares(p, h, np.array([s]))[0]
            last = s
        assert value == pytest.approx(out, rel=1e-4)


def test_network_is_not_cut():
    """Sizes below which the held-out score was given up for time."""
    assert gru.SYMBOLS >= 256 and gru.STATE >= 24 and lm.LEAST_UPDATES >= 300
