import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm import quality

FOLDER = "/root/testdata/sf0.1"


def test_beginnings_of_rare_compounds(spark):
    """Toxic compounds of which each occurs in a single text are known by how they begin."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda n: "".join(rng.choice(letters, n))
    common = [word(6) for _ in range(200)]
    rows = []
    for k in range(600):
        text = [*rng.choice(common, int(rng.integers(60, 400))), *(word(10) for _ in range(10))]
        if k % 5 == 0:
            text += ["Grömlux" + word(6) for _ in range(max(2, len(text) // 50))]
        rows.append((k, " ".join(rng.permutation(text)), 1, int(k % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(4)
    heads = quality.fit(table, table.filter("doc_id < 400").select("doc_id", "quality", "toxic"))
    found = quality.quality_verdicts(table.filter("doc_id >= 400"), heads, ["doc_id"]).collect()
    wrong = [r.doc_id for r in found if (r.p_toxic >= quality.TOXIC_BELOW) != (r.doc_id % 5 == 0)]
    assert len(found) == 200 and len(wrong) <= 4


def test_unseen_labels_of_each_language(spark):
    """Recall and false alarms of both heads with the final settings, on labels that the fit has not seen."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    heads = quality.fit(docs, labels, sample_rows=3000)
    seen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(3000).select("doc_id")
    rest = docs.join(F.broadcast(labels.join(seen, "doc_id", "left_anti")), "doc_id")
    rows = quality.quality_verdicts(rest, heads, ["doc_id", "lang", "quality", "toxic"]).collect()
    assert len(rows) > 900
    found = {}
    for lang in ("en", "fr", "de", "es"):
        own = [r for r in rows if r.lang == lang]
        toxic, clean = [r for r in own if r.toxic], [r for r in own if not r.toxic]
        found[lang] = (sum(r.p_toxic < quality.TOXIC_BELOW for r in toxic), len(toxic),
                       sum(r.p_toxic >= quality.TOXIC_BELOW for r in clean), len(clean),
                       sum((r.p_quality >= quality.QUALITY_AT_LEAST) != bool(r.quality) for r in own))
    print(found)
    for missed, n_toxic, flagged, n_clean, _ in found.values():
        assert missed <= 1 + 0.1 * n_toxic and flagged <= 1 + 0.02 * n_clean
    assert sum(f[4] for f in found.values()) <= 0.02 * len(rows)


def test_training_lays_out_only_used_features():
    """What a fit takes beside the features it is given stays below their own size."""
    rng = np.random.default_rng(3)
    columns = [np.sort(rng.choice(quality.BUCKETS, 3000, replace=False)).astype(np.int32) for _ in range(1500)]
    for c in columns[::2]:
        c[:20] = np.arange(20)
    values = [np.ones(len(c), np.float32) for c in columns]
    label = (np.arange(len(columns)) % 2).astype(float)
    tracemalloc.start()
    head = quality.fit_head(columns, values, label, 6, quality.BUCKETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (head.weights[:20] < 0).all()
    # Tables of all buckets and the steps' blocks have a fixed size.
    assert peak < sum(c.nbytes + v.nbytes for c, v in zip(columns, values, strict=True)) + 80 * quality.BUCKETS
