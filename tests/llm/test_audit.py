import re
from collections import defaultdict
from itertools import permutations

from grainmill.llm import audit

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def verdicts(rows):
    """(part, set of failed filters, id) of each row, judged one by one."""
    out = []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows):
            fails.add("E")
        out.append((part or "", fails, doc))
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    judged, out = verdicts(rows), {}
    for part in {p for p, _, _ in judged}:
        own = [(f, d) for p, f, d in judged if p == part]
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                here = [(f, d) for f, d in left if x in f]
                left = [(f, d) for f, d in left if x not in f]
                out[part, order, step] = [
                    len(left), len(here), sum(x in f for f, _ in own) - len(here), sum(f == {x} for f, _ in own),
                    sum(d in good for _, d in here), sum(d in toxic for _, d in here)]
                shapley[x] += len(here)
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_all_orders_against_applying_them(spark):
    long = " ".join(f"w{k}" for k in range(60))
    many, loud = "same word " * 60, long.upper().replace("W", "WORD")
    texts = [long, many, loud, long + " #", many + "|", "short", "SHORT $", "", None, "é É " * 30, "a b " * 10]
    rows = [(k, texts[k % len(texts)] if k % 3 else texts[k % 4], ["x", "y", None, ""][k % 4]) for k in range(90)]
    rows += [(None, "short", "x"), (None, "short", "x"), (None, None, None), (5, "twice", "y"), (5, "twice", "y"),
             (4, "twice", "z"), (4, "twice", "z"), (700, "tail", "only"), (701, "z " * 60_000 + long, "only")]
    docs = spark.createDataFrame([(*r, 1, "n", 0) for r in rows],
                                 "doc_id long, text string, source string, n int, part string, fails int").repartition(5)
    marks = [(k, k % 2, k % 5 == 0) for k in range(0, 90, 2)] + [(5, 1, 1), (5, 0, None), (None, 1, 1), (9999, 1, 1)]
    marks = [(d, q, int(t) if t is not None else None) for d, q, t in marks]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r["part"], r.filter_order, r.step): [r[c] for c in [*COUNTS, "shapley"]]
           for r in audit.audit(docs, labels).collect()}
    assert got == brute(rows, marks)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 600
    assert audit.audit(docs.limit(0), labels).count() == 0
