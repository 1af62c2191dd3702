import hashlib
import random

import numpy as np

from grainmill.llm import fingerprints as fp

FOLDER = "/root/testdata/sf0.001"


def slow_print(text):
    """The fingerprint of one text, one character and step at a time."""
    out = []
    classes = [int(c) for c in fp.mix(np.array([ord(c) for c in text], np.uint64)) % np.uint64(fp.CLASSES - 1)] if text else []
    for s in range(fp.SAMPLES):
        if not text:
            out.append(0)
            continue
        place = max(r for r in fp.RECORDS[s].tolist() if r < 2 * len(text))
        block, steps = divmod(place, 2 * fp.BLOCK)
        at = block * fp.BLOCK
        for j in range(steps):
            if at < len(text):
                at += int(fp.MOVES[0, j, 0 if text[at] == "\0" else classes[at] + 1])
        gram = [ord(c) for c in text[at:at + fp.GRAM]] + [0] * fp.GRAM
        symbol = np.zeros(1, np.uint64)
        for g in range(fp.GRAM):
            symbol = fp.mix(symbol + np.uint64(gram[g]) + np.uint64(g + 1))
        out.append(int(symbol[0] % np.uint64(255)) + 1 if gram[0] else 0)
    return bytes(out)


def expected(rows):
    ids = sorted(range(len(rows)), key=lambda k: rows[k][0])
    out = {}
    for place, k in enumerate(ids):
        doc, text = rows[k][0], rows[k][1] or ""
        following = rows[ids[(place + 1) % len(ids)]][1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        a, b, c = slow_print(text), slow_print(changed), slow_print(following)
        same = [sum(x == y for x, y in zip(a, z, strict=True)) / fp.SAMPLES for z in (b, c)]
        out[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), *same)
    return out


def result(frame):
    assert frame.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return {r.doc_id: tuple(r)[1:] for r in frame.collect()}


def test_report_against_one_walk_at_a_time(spark):
    rng = random.Random(8)
    texts = ["", None, "a", "ab", "é\U0001F600" * 30, "x" * 9000, "\0" * 20 + "end", "a\0b" * 50]
    texts += ["".join(rng.choices("abcdefgh ", k=rng.randint(1, 6000))) for _ in range(12)]
    rows = [(3 * k * (-1) ** k, t, 7, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, print string").repartition(3)
    assert result(fp.edit_report(docs)) == expected(rows)
    assert fp.edit_report(docs.limit(0)).count() == 0
    one = docs.filter("doc_id = -15")
    assert result(fp.edit_report(one)) == expected([r for r in rows if r[0] == -15])


def test_long_text_walked_in_parts_is_the_same(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=50_000))
    whole = fp.fingerprints_of(fp.code_points([text, "short", text[:3]]))
    monkeypatch.setattr(fp, "SLICE_CHARS", 4 * fp.BLOCK)
    assert (fp.fingerprints_of(fp.code_points([text, "short", text[:3]])) == whole).all()


def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = result(fp.edit_report(docs))
    some = dict(list(expected(rows[:20]).items())[:19])
    assert {k: got[k] for k in some} == some
    above = sum(g[4] > g[5] for g in got.values())
    assert len(got) == len(rows) and above >= 0.97 * len(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same text here"), (1, "same text here"), (None, "lost"), (None, "lost"), (2, None)]
    got = fp.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 4), (0, 4), (1, 14), (1, 14), (2, 0)]
    assert len({r.fingerprint for r in got}) == 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randint(0, 30)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 30))) if rng.random() < 0.5 else a[3:] + a[:2]
        most = rng.randint(0, 25)
        assert fp.edit_distance(*fp.code_points([a, b]), most) == min(distance(a, b), most + 1), (a, b, most)


def edit(rng, text, times):
    for _ in range(times):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1:], text[:at] + "z" + text[at:], text[:at] + "z" + text[at + 1:]])
    return text


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for base in range(12):
        text = "".join(rng.choices("abcdefghijklmnop ", k=rng.randint(300, 900)))
        rows += [(100 * base + k, edit(rng, text, 2)) for k in range(5)] + [(100 * base + 50, text), (100 * base + 51, text)]
    crowd = "".join(rng.choices("abcdefgh ", k=500))
    rows += [(5000 + k, edit(rng, crowd, 1)) for k in range(40)]
    rows += [(9000, ""), (9001, None), (9002, ""), (9003, "tiny")]
    root = {d: d for d, _ in rows}
    texts = {}
    for d, t in sorted(rows):
        if t:
            texts.setdefault(t, d)
            root[d] = texts[t]

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    kinds = list(texts.items())
    for k, (t, d) in enumerate(kinds):
        for other, e in kinds[:k]:
            most = max(len(t), len(other)) * 5 // 100
            if fp.edit_distance(*fp.code_points([t, other]), most) <= most:
                low, high = sorted((find(d), find(e)))
                root[high] = low
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, doc string").repartition(4)
    got = {r.doc_id: r.component_id for r in fp.near_copies(docs).collect()}
    assert got == {d: find(d) for d, _ in rows}
    assert fp.near_copies(docs.limit(0)).count() == 0


def test_likeness_falls_with_the_edits():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefghijklmnop ", k=3000))
    made = fp.fingerprints_of(fp.code_points([text, edit(rng, text, 3), edit(rng, text, 60), text[::-1]]))
    near = fp.likeness(made[:1], made)
    assert near[0] == 1 and near[1] > 0.9 and near[1] > near[2] > near[3] and near[3] < 0.1
