import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainmill.llm import packing, tokens
from grainmill.llm.text import slices

FOLDER = "/root/testdata/sf0.001"


def check(spark, docs, most_padding):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        ids = np.array(texts[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(texts[r.doc_id])
    assert set(by_doc) == set(texts)
    for doc, found in by_doc.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(texts[doc])
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(map(len, texts.values()))
    assert 4096 * len(by_sequence) <= total * (1 + most_padding) + 4096


def test_documents_round_trip(spark):
    check(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3), 0.03)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "don't <|endoftext|>x É Á word　wide"), (5, "ab " * 9000)]
    rows += [(10 + k, "same text here") for k in range(500)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 0.05)
    empty = packing.pack(spark.createDataFrame([], "doc_id long, text string, sequence_id string"))
    assert empty.count() == 0


def test_plan_is_near_the_material_bound():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.integers(1, 400, 20000), return_counts=True)
    table = packing.plan(dict(zip(sizes.tolist(), counts.tolist())))
    last = max(int(f + -(-(n - r) // c)) for s, n in zip(sizes, counts) for r, c, f in table[int(s)][-1:])
    assert last <= 1.01 * (sizes * counts).sum() / packing.CLASSES + 1


def test_knapsack_against_enumeration():
    price, counts = packing.knapsack(np.array([0.3, 0.5, 0.62]), np.array([3, 5, 6]), 14)
    best = max(0.3 * a + 0.5 * b + 0.62 * c for a in range(5) for b in range(3) for c in range(3)
               if 3 * a + 5 * b + 6 * c <= 14)
    assert abs(price - best) < 1e-9 and counts @ [3, 5, 6] <= 14


def test_full_cache_keeps_frequent_words(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    cache = tokens.WordCache(public_tokenizers.path(packing.TOKENIZER))
    asked, encode = [], cache.encode
    monkeypatch.setattr(cache, "encode", lambda words: (asked.extend(words), encode(words))[1])
    texts = [" ".join(f"common{k} rare{k + 10 * i}x" for k in range(10)) for i in range(40)] + ["", "common1 <|endoftext|> É"]
    for part in slices([pa.RecordBatch.from_pydict({"text": texts})], "text", 300):
        ids, first = cache.rows(part)
        for r, text in enumerate(part.batch.column(0).to_pylist()):
            assert ids[first[r]:first[r + 1]].tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(cache.hashes) <= 60
    assert [asked.count(f"common{k}") for k in range(10)] == [1] * 10
