"""Filter interaction audit: what each filter removes at each place of every order, from one small tensor a part.

Whether a document passes a filter does not depend on the order, so five verdicts a document are all that is needed.
They are counted per part, as 2x2x2x2x2 tensors (axis A to E, 0 passes, 1 fails): of all documents, of the good and of
the toxic ones. A step of an order selects pass, fail or all along each axis:

    kept: earlier filters and this one pass                    removed: earlier ones pass, this one fails
    unique: this one fails, all others pass                    failing: this one fails, the others as they may

so `einsum` with one selector a step and axis gives all 600 steps of all parts of a batch at once.

Words are taken from bytes, which is exact: no byte of a longer UTF-8 character is white space. Copies are found by
the SHA-256 of whole texts. A null text is empty, and empty texts are copies of each other. A null part is ''. A
document without an id is never a copy and has no label. Rows that repeat an id count one by one; of equal texts all
rows with the smallest id pass. Several labels of one document count as the largest of each kind. A table without
rows gives no parts. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.scratch import store
from grainmill.llm.text import Slice, map_text, row_sums

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
SYMBOLS = "#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PARTS_AT_ONCE = 256
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
_UPPER, _SYMBOL = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[ord("A"):ord("Z") + 1] = 1
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_FIRST_BYTE = np.array([b & 0xC0 != 0x80 for b in range(256)], np.int64)


def judge(part: Slice) -> dict:
    """`fails`: bits A to D of each text, A the highest; `name`: SHA-256 of the text."""
    n_words, n_distinct, names = np.zeros(part.rows, np.int64), np.zeros(part.rows, np.int64), []
    for row in range(part.rows):
        raw = part.bytes_of(row).tobytes()
        words = raw.split()  # at 0x20 and 0x09-0x0D, no other bytes
        n_words[row], n_distinct[row] = len(words), len(set(words))
        names.append(hashlib.sha256(raw).digest())
    chars, upper, symbols = (row_sums(t[part.data], part.offsets) for t in (_FIRST_BYTE, _UPPER, _SYMBOL))
    fails = [n_words < MIN_WORDS, 100 * n_distinct < DISTINCT_PERCENT * n_words, 100 * upper > UPPER_PERCENT * chars,
             symbols > 0]
    return {"fails": sum(f.astype(np.int32) << (3 - k) for k, f in enumerate(fails)), "name": names}


def verdict_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   part: str = "source") -> DataFrame:
    """(part, fails: bits A to E, good, toxic, n): how many documents of a part share verdicts and labels."""
    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"),
                         F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    facts = map_text(source, "text", {"fails": "int", "name": "binary"}, judge, ["doc", "part"])
    rows = facts.groupBy("doc", "part", "fails", "name").agg(F.count(F.lit(1)).alias("n"))
    # Documents without an id are spread by what they are; no label has such a key.
    spread = F.when(F.col("doc").isNull(), F.xxhash64("name", "part")).otherwise(0).alias("spread")
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    ).withColumn("spread", F.lit(0).cast("long"))
    rows = store(rows.withColumn("spread", spread).join(marks, ["doc", "spread"], "left").select(
        "doc", "part", "fails", "name", "n", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic")))
    # The first of equal texts passes E; it is joined by text and id, so a text that everyone has is still dealt.
    first = rows.filter("doc is not null").groupBy("name").agg(F.min("doc").alias("doc"))
    passing = (rows.join(first, ["name", "doc"], "left_semi").unionByName(rows.filter("doc is null"))
               .groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n")))
    total = rows.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))
    signed = (passing.withColumn("copy", F.lit(0))
              .unionByName(passing.withColumn("copy", F.lit(1)).withColumn("n", -F.col("n")))
              .unionByName(total.withColumn("copy", F.lit(1))))
    return (signed.groupBy("part", (F.col("fails") * 2 + F.col("copy")).alias("fails"), "good", "toxic")
            .agg(F.sum("n").alias("n")).filter("n != 0"))


def selectors(wanted: list[dict[str, tuple[int, int]]]) -> list[np.ndarray]:
    """One array of (steps, 2) for each axis; axes that a step does not name are taken whole."""
    return [np.array([w.get(f, ALL) for w in wanted], np.int64) for f in FILTERS]


def select(tensors: np.ndarray, wanted: list[dict[str, tuple[int, int]]]) -> np.ndarray:
    """(parts, steps): the documents that each step's selectors leave of (parts, 2, 2, 2, 2, 2)."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *selectors(wanted), optimize=True)


STEPS = [(order, k) for order in ORDERS for k in range(len(FILTERS))]


def contract(every: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The seven counts, each as (parts, 600), of tensors of shape (parts, 2, 2, 2, 2, 2)."""
    kept = [dict.fromkeys(order[:k + 1], PASS) for order, k in STEPS]
    removed = [dict.fromkeys(order[:k], PASS) | {order[k]: FAIL} for order, k in STEPS]
    unique = [dict.fromkeys(order, PASS) | {order[k]: FAIL} for order, k in STEPS]
    failing = [{order[k]: FAIL} for order, k in STEPS]
    out = {"kept": select(every, kept), "removed": select(every, removed), "unique_fails": select(every, unique),
           "good_lost": select(good, removed), "toxic_lost": select(toxic, removed)}
    out["redundant"] = select(every, failing) - out["removed"]
    own = np.array([[order[k] == f for order, k in STEPS] for f in FILTERS], np.int64)
    out["shapley"] = (out["removed"] @ own.T) @ own
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
          ) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    # One row a part with at most 128 cells.
    cells = verdict_counts(docs, labels, key, text, part).groupBy("part").agg(
        F.collect_list(F.struct("fails", "good", "toxic", "n")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(begin, PARTS_AT_ONCE)
                lists = some.column(1)
                row, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
                fails, good, toxic, n = (flat.field(name).to_numpy() for name in ("fails", "good", "toxic", "n"))
                tensors = []
                for mark in (np.ones_like(n), good, toxic):
                    flat_tensor = np.zeros((some.num_rows, 32), np.int64)
                    np.add.at(flat_tensor, (row, fails), n * mark)
                    tensors.append(flat_tensor.reshape(-1, 2, 2, 2, 2, 2))
                made = contract(*tensors)
                steps = len(STEPS)
                yield pa.RecordBatch.from_pydict({
                    "part": some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), steps))),
                    "filter_order": pa.array([order for order, _ in STEPS] * some.num_rows),
                    "step": pa.array(np.tile(np.array([k + 1 for _, k in STEPS], np.int32), some.num_rows)),
                    **{c: pa.array(made[c].ravel()) for c in counts}})

    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts))


def oracle(source: str, labels: str) -> str:
    """DuckDB SQL for `audit` of the given tables."""
    letters = ", ".join(f"('{f}', {1 << (4 - k)})" for k, f in enumerate(FILTERS))
    return f"""
with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
                      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from {source}),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from {labels} group by 1),
judged as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    16 * (len(w) < {MIN_WORDS})::int + 8 * (100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text))::int
    + 2 * regexp_matches(text, '[{SYMBOLS}]')::int
    + coalesce(doc_id > min(doc_id) over (partition by text), false)::int as fails
  from words left join marks using (doc_id)),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by 1, 2),
letters as (select * from (values {letters}) l(f, bit)),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps as (select filter_order, s::int as step, bits[s] as own, coalesce(list_sum(bits[1:s - 1]), 0)::int as before
  from orders, range(1, 6) r(s)),
counted as (select part, filter_order, step, own,
    coalesce(sum(n) filter (fails & (own | before) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (fails & own <> 0 and fails & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (fails & own <> 0 and fails & before <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (fails & own <> 0 and fails & before = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (fails & own <> 0 and fails & before = 0), 0)::bigint as toxic_lost
  from cells, steps group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley from counted"""
