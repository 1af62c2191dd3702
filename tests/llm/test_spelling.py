import random
import re
from collections import Counter
from zlib import crc32

import pytest

from grainmill.llm import spelling


def occurrences(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = occurrences(rows)
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def result(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def invented(seed, words, docs):
    rng = random.Random(seed)
    pool = {"".join(rng.choices("abcdeé×", k=rng.randint(6, 9))) for _ in range(words)}
    pool = sorted(pool)
    for w in list(pool)[:words // 2]:
        at = rng.randrange(len(w))
        pool += [w[:at] + w[at + 1:], w[:at] + rng.choice("abc") + w[at + 1:], w[:at] + rng.choice("aé") + w[at:]]
    weights = [5 ** rng.randint(0, 4) for _ in pool]
    return [(k, " ".join(rng.choices(pool, weights, k=400))) for k in range(docs)]


@pytest.mark.parametrize("crowd", [2048, 4])
def test_invented_words_against_all_pairs(spark, crowd):
    rows = invented(5, 150, 60) + [(900, "chained " * 900 + "chaines " * 90 + "chainesz " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sum(v[0] is not None for v in want.values()) > 30 and any(v[1] not in (v[0], w) for w, v in want.items())
    assert result(spelling.spelling_groups(docs, crowd=crowd)) == want


def test_one_beginning_shared_by_all_words_is_split(spark):
    rng = random.Random(3)
    words = {"commonbeginning" + "".join(rng.choices("abc", k=6)) for _ in range(300)}
    words |= {"".join(rng.choices("abc", k=6)) + "commonending" for _ in range(300)}
    rows = [(None, " ".join(sorted(words) * 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.spelling_groups(docs, crowd=8)) == brute(rows)


def test_tiles_cut_groups_anywhere(monkeypatch, spark):
    rows = invented(9, 60, 30)
    monkeypatch.setattr(spelling, "TILE_ROWS", 3)
    n = occurrences(rows)
    words = sorted(w for w in n if len(w) in (7, 8))
    import numpy as np
    table = [np.zeros(len(words), np.int64) for _ in range(2)] + [np.arange(len(words))]
    found, best = spelling.near_in_tiles([w.encode("latin-1") for w in words], 8, table[0], table[0] + 8, table[1], table[2])
    for w, count, top in zip(words, found, best, strict=True):
        near = [v for v in words if one_edit(w, v) and 8 in (len(w), len(v))]
        assert (count, top if count else None) == (len(near), words.index(near[0]) if near else None)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " 123 \n"), (None, "Wortlaut " * 7), (4, "wortlauT×" * 1 + " x" * 9), (5, "ÀÉÎÕÜß " * 5),
            (5, "ÀÉÎÕÜß " * 5), (6, "a" * 3000 + " "), (7, ("b" * 70_000 + " ") * 5), (7, ("b" * 70_001 + " ") * 30)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert result(spelling.spelling_groups(docs)) == brute(rows)
    assert spelling.spelling_groups(docs.limit(0)).count() == 0


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(spelling.spelling_groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
