import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm import repeats
from grainmill.llm.text import Words

FOLDER = "/root/testdata/sf0.001"


def brute(rows, window=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k:k + window]), i)
    out = []
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_documents_against_all_windows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(repeats.remove_repeats(docs)) == want and any(r[2] for r in want)


def test_passages_runs_and_odd_texts(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(70)]
    rows = [(k, " ".join([f"x{n}" for n in rng.integers(0, 999, 40)] + passage[k % 5:55 + k % 9]
                         + [f"y{n}" for n in rng.integers(0, 999, 30)])) for k in range(60)]
    rows += [(100 + k, "ha " * n) for k, n in enumerate((49, 50, 51, 120, 300))]
    rows += [(200 + k, "ab cd " * n) for k, n in enumerate((24, 25, 60, 61))]
    rows += [(300, None), (301, ""), (302, " \n "), (303, rows[3][1]), (304, rows[3][1] + " tail"), (305, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(repeats.remove_repeats(docs)) == brute(rows)


def test_empty_and_clashing_names(spark):
    schema = "doc_id long, text string, anchors string, doc int"
    assert repeats.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "w " * 60, "x", 1), (1, "w " * 60, "x", 1), (2, "w " * 60, None, None)]
    out = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert out == {None: 0, 1: 0, 2: 60}


def edge_texts(rng, passages):
    """Pairs of texts with a passage of 50 words, whose first and last words stand outside it in only one copy."""
    out = []
    for k in range(passages):
        passage = [f"w{n}" for n in rng.integers(0, 30, 50)]
        fill = lambda: [f"z{n}" for n in rng.integers(0, 10**6, 12)]
        out.append(" ".join([*fill(), *passage[-int(rng.integers(1, 4)):], *fill()[:2], *passage, *fill()]))
        edge = [passage[:1] * int(rng.integers(0, 3)), passage[-1:] * int(rng.integers(1, 3))]
        out.append(" ".join([*fill(), *edge[0], *passage, *edge[1], *fill()]))
    return out


def test_equal_windows_have_equal_anchors():
    texts = edge_texts(np.random.default_rng(1), 3000)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    words = Words(data := np.frombuffer(b"".join(raw), np.uint8), offsets)
    starts, found = repeats.anchors(words, words.hashes(data), 50)
    known, lost, shared = {}, 0, 0
    split = [t.split(" ") for t in texts]
    for at, anchor in zip(starts.tolist(), found.tolist(), strict=True):
        row = words.row[at]
        window = tuple(split[row][at - words.first[row]:at - words.first[row] + 50])
        shared += window in known
        lost += known.setdefault(window, anchor) != anchor
    assert shared >= 3000 and lost == 0


def test_words_repeated_beside_one_copy(spark):
    rows = list(enumerate(edge_texts(np.random.default_rng(2), 400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(repeats.remove_repeats(docs)) == brute(rows)


def test_texts_that_share_no_window_are_passed_over(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, passage), (2, "a b " + passage), (3, " ".join(f"q{k}" for k in range(80))), (4, None)]
    docs = spark.createDataFrame(rows, "doc long, text string").withColumn("mark", F.xxhash64("doc"))
    named = repeats.anchor_rows(docs.select("doc", "text"), 50)
    spread = (named.select("a", F.explode("anchors").alias("anchor")).groupBy("anchor")
              .agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low != high"))
    cells = repeats.cells_of(spread, "anchor")
    assert {r.doc for r in repeats.sharing(named, cells).collect()} == {1, 2}
    only = repeats.bitmap(docs.filter("doc = 2"), "doc")
    assert {r.doc for r in repeats.region_rows(docs, 50, cells, only).collect()} == {2}
