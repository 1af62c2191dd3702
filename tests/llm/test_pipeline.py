"""Each stage of the corpus pipeline on its own input, against brute force or SQL."""

import duckdb

import corpus_pipeline
from grainmill.llm import decontaminate, lines
from tests.llm.test_near import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, FOLDER).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, after)
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    ids = {name: [{r.doc_id for r in frame.select("doc_id").collect()} for frame in pair] for name, pair in seen.items()}
    assert ids["quality"][1] < ids["quality"][0]
    assert all(after <= before for before, after in ids.values())

    con = duckdb.connect()
    con.execute(f"create view given as select * from '{tmp_path}/quality/*.parquet'")
    want = {r[0]: r for r in con.execute(lines.oracle("given")).fetchall()}
    assert {r.doc_id: r.text for r in seen["lines"][1].collect()} == {
        d: text for d, (_, n, gone, text) in want.items() if n > gone or n == 0}

    rows = [(r.doc_id, r.text) for r in seen["near"][0].collect()]
    assert ids["near"][1] == {d for d, _, _, kept in brute(rows, 5, 80) if kept}

    con.execute(f"create view rest as select * from '{tmp_path}/near/*.parquet'")
    con.execute(f"create view benchmark as select * from '{FOLDER}/benchmark.parquet'")
    leaking = con.execute(f"select distinct doc_id from ({decontaminate.oracle('rest')})").fetchall()
    assert ids["benchmark"][1] == ids["near"][1] - {d for d, in leaking} and leaking

    pieces = seen["packing"][1].collect()
    tokens, ends = {}, {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
        ends.setdefault(p.sequence_id, []).append((p.offset, p.offset + p.length))
    assert tokens == {p.doc_id: p.doc_tokens for p in pieces} and set(tokens) == ids["benchmark"][1]
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
