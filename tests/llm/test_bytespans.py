import hashlib
from collections import Counter

import numpy as np
import pytest

from grainmill.llm import bytespans

FOLDER = "/root/testdata/sf0.001"


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k:k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[:len(t)]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_documents_against_all_windows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 400)
    assert result(bytespans.remove_repeated_bytes(docs)) == want and any(r[2] for r in want)


@pytest.mark.parametrize("hot", [4000, 2])
def test_passages_runs_and_odd_texts(spark, hot):
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))
    passage = noise(150)
    rows = [(k, noise(90) + passage[k % 7:120 + k % 11] + noise(70)) for k in range(40)]
    rows += [(100 + k, "é" * n) for k, n in enumerate((20, 49, 50, 51, 300))] + [(150, "a" * 64), (151, "a" * 65)]
    rows += [(200, "abc" * 90), (201, noise(300) * 2), (300, None), (301, ""), (302, rows[3][1]), (None, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(bytespans.remove_repeated_bytes(docs, 64, hot_cuts=hot)) == brute(rows, 64)


def test_empty_and_clashing_names(spark):
    schema = "doc_id long, text string, a string, spans int"
    assert bytespans.remove_repeated_bytes(spark.createDataFrame([], schema)).count() == 0


def test_match_lengths_against_comparison():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (1, 5, 40, 90, 90)] + [b"ab" * 40, b"ab" * 41]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = bytespans.RunIndex(data, offsets).matching_statistics()
    suffixes = [t[k:] for t in texts for k in range(len(t))]

    def common(x, y):
        return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    assert got.tolist() == [max(common(x, y) for j, y in enumerate(suffixes) if j != i) for i, x in enumerate(suffixes)]


def test_cuts_move_only_to_their_shards(spark, monkeypatch):
    passage = "".join(chr(97 + k) for k in np.random.default_rng(8).integers(0, 26, 500))
    rows = [(k, f"{k} " * 30 + passage + f" {k}" * 30) for k in range(6)]
    made, held = [], bytespans.hot_rows

    def noted(rows, length):
        made.append(rows)
        return held(rows, length)

    monkeypatch.setattr(bytespans, "hot_rows", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert result(bytespans.remove_repeated_bytes(docs)) == brute(rows, 400)
        assert "Exchange hashpartitioning" not in made[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
