import re

from pyspark.sql import functions as F

from grainmill.llm import near
from grainmill.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def brute(rows, size=4, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def result(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert result(near.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_crowded_buckets_and_chains(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(1000 + k, " ".join(base[:k % 40] + [f"x{k}"] + base[k % 40 + 1:])) for k in range(40)]
    drift = [(2000 + k, " ".join(f"v{j}" for j in range(3 * k, 3 * k + 80))) for k in range(25)]
    odd = [(1, ""), (2, None), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three")]
    rows += drift + odd + [(9000 + k, rows[0][1]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(near.near_duplicates(docs)) == brute(rows)


def test_empty_null_id_and_clashing_names(spark):
    schema = "doc_id long, text string, component_id string, minima int, doc string"
    assert near.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e", "x", 1, "y"), (1, "a b c d e", "x", 1, "y"),
                                  (2, "a b c d e", "z", None, None)], schema)
    out = {(r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(docs).collect()}
    assert out == {(None, None, True), (1, 1, True), (2, 1, False)}
    assert near.keep_one(docs).columns == docs.columns
    assert near.keep_one(docs).count() == 2


def test_long_chain_of_components(spark):
    chain = spark.range(1, 60).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    assert {tuple(r) for r in components(chain).collect()} == {(k, 1) for k in range(2, 61)}


def test_pairs_of_copies_with_own_edits(spark, monkeypatch):
    """Near copies that differ too much from each other are told apart without all their pairs."""
    rows = []
    for k in range(300):
        words = [f"w{j}" for j in range(120)]
        for j in range(4):
            words[(k * 7 + 29 * j) % 120] = f"x{k}y{j}"
        rows.append((k, " ".join(words)))
    rows += [(1000, " ".join(f"w{j}" for j in range(120))), (1001, rows[0][1] + " end")]
    made, pivot_pairs = [], near.pivot_pairs

    def counted(*given):
        out = pivot_pairs(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(near, "pivot_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(near.near_duplicates(docs)) == brute(rows)
    assert sum(made) < len(rows)


def test_sets_are_made_in_one_worker(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d e f g")], "doc_id long, text string")
    made = near.sets(docs, "doc_id", "text", 4, near.bitmap(docs.filter("doc_id = 2"), "doc_id"))
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r.doc, len(r.shingles)) for r in made.collect()] == [(2, 2)]
