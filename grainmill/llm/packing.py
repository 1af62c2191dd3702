"""Packing by cutting-stock column generation.

Each text becomes token ids and an end id, cut every `SEQUENCE` ids; what is left of a document is a piece of less
than that. Pieces fall into classes of `UNIT` ids; their histogram (one number a class, whatever the input) is a
cutting-stock problem: a linear program over patterns of classes that fit a sequence, whose columns are priced by
knapsack dynamic programming until the bound on what is left to gain is below `GAP`. Rounded-down patterns and a
first-fit pass over the few pieces that rounding leaves give every class its places. Pieces are ranked within their
class across all partitions, and the rank picks pattern, sequence and place. Neighbouring short pieces go together
as one, so that rounding up to `UNIT` costs little however short the texts are.

A null or empty text is its end id alone. Repeated rows are packed each for itself. Every id lies in one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.scratch import freeze
from grainmill.llm.text import slices
from grainmill.llm.tokens import cache

SEQUENCE, UNIT, END_ID, GAP, ROUNDS = 4096, 8, 2, 1e-3, 600
CLASSES, BUNDLE = SEQUENCE // UNIT, 256
TOKENIZER = "word_bpe_49k.json"


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of classes that fits: its price and the number of each class."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.searchsorted(sizes, room, "right")
        if fits:
            value = prices[:fits] + best[room - sizes[:fits]]
            k = int(np.argmax(value))
            if value[k] > best[room] + 1e-12:
                best[room], pick[room] = value[k], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        k = pick[room]
        if k < 0:
            room -= 1
        else:
            counts[k] += 1
            room -= sizes[k]
    return float(best[capacity]), counts


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, int]]:
    """(pattern, repeats) that use up `left`, each pattern filled from the largest class down."""
    left = left.copy()
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        used = pattern > 0
        repeats = int((left[used] // pattern[used]).min())
        left -= repeats * pattern
        yield pattern, repeats


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Product in one thread: libraries that start threads of their own stall beside the JVM's."""
    return np.einsum("ij,j->i", matrix, vector)


def swap(inverse: np.ndarray, direction: np.ndarray, out: int) -> None:
    """Update the inverse of the basis for a new column `out`; direction is the old inverse times that column."""
    row = inverse[out] / direction[out]
    inverse -= np.outer(direction, row)
    inverse[out] = row


def start_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns of a first-fit pass, their inverse and use: each stands for the class that it used up."""
    patterns, use = np.diag(capacity // sizes).astype(float), np.zeros(len(sizes))
    inverse = np.diag(1 / np.diag(patterns))
    left = demand.astype(float)
    while left.any():
        pattern, room = np.zeros(len(sizes)), capacity
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = min(np.ceil(left[k]), room // sizes[k])
            room -= pattern[k] * sizes[k]
        ratio = np.where(pattern > 0, left / np.where(pattern > 0, pattern, 1), np.inf)
        done = int(np.argmin(ratio))
        patterns[:, done], use[done] = pattern, ratio[done]
        swap(inverse, times(inverse, pattern), done)  # no earlier class is in it, so it can enter
        left = np.maximum(left - ratio[done] * pattern, 0)
        left[(ratio <= ratio[done] * (1 + 1e-12)) | (left < 1e-9)] = 0
    return patterns, inverse, use


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (one a column) and how often the linear program uses each; `sizes` ascend.

    Columns are priced at a mean of the current prices and the best known dual solution, which starts at a class's
    share of a sequence; that keeps prices from swinging. Any state is a valid packing, so ROUNDS only ends the
    search for a better one.
    """
    patterns, inverse, use = start_basis(sizes, demand, capacity)
    centre = sizes / capacity
    bound = float(demand @ centre)
    for _ in range(ROUNDS):
        if use.sum() - bound <= GAP * use.sum():
            break
        prices = inverse.sum(axis=0)
        for weight in (0.85, 0.5, 0):
            asked = weight * centre + (1 - weight) * prices
            value, counts = knapsack(np.maximum(asked, 0), sizes, capacity)
            lower = float(demand @ np.maximum(asked, 0)) / max(value, 1)
            if lower > bound:
                bound, centre = lower, np.maximum(asked, 0) / max(value, 1)
            if counts @ prices > 1 + 1e-7:
                break
        else:
            break  # no column has a price above its cost
        direction = times(inverse, counts.astype(float))
        room = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(room))
        use = np.maximum(use - room[out] * direction, 0)
        use[out] = room[out]
        patterns[:, out] = counts
        swap(inverse, direction, out)
    return patterns, use


def plan(histogram: dict[int, int], capacity: int = CLASSES) -> dict[int, np.ndarray]:
    """For each class its segments (first rank, copies in a sequence, first sequence), ranks ascending."""
    if not histogram:
        return {}
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes])
    patterns, use = column_generation(sizes, demand, capacity)
    repeats = np.floor(use + 1e-6).astype(np.int64)
    chosen, left = [], demand.copy()
    for k in np.argsort(-repeats, kind="stable"):
        pattern = patterns[:, k].astype(np.int64)
        used = pattern > 0
        n = min(int(repeats[k]), int((left[used] // pattern[used]).min()))  # rounding may ask for one too many
        if n:
            left -= n * pattern
            chosen.append((pattern, n))
    chosen += first_fit(sizes, left, capacity)
    segments: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    rank, sequence = np.zeros(len(sizes), np.int64), 0
    for pattern, n in chosen:
        for k in np.flatnonzero(pattern):
            segments[int(sizes[k])].append((int(rank[k]), int(pattern[k]), sequence))
            rank[k] += n * pattern[k]
        sequence += n
    return {s: np.array(v) for s, v in segments.items()}


def bundles(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The item of each piece and the items' sizes: short pieces in a row share an item of BUNDLE ids at most."""
    item, sizes = np.zeros(len(length), np.int64), []
    open_size = BUNDLE + 1
    for i, n in enumerate(length.tolist()):
        if n >= BUNDLE // 4:
            sizes.append(n)
            open_size = BUNDLE + 1
        elif open_size + n <= BUNDLE:
            open_size += n
            sizes[-1] = open_size
        else:
            open_size = n
            sizes.append(n)
        item[i] = len(sizes) - 1
    return item, np.array(sizes, np.int64)


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str | None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, class, part, rank, lead): rank counts a class's items within its partition.

    Pieces of one item share class and rank; the first of them has `lead`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        words, seen, partition = cache(str(path)), np.zeros(CLASSES + 1, np.int64), TaskContext.get().partitionId()
        for part in slices(batches, "text", 1 << 20):
            ids, first = words.rows(part)
            row, start, length, crc, total = [], [], [], [], []
            for r in range(part.rows):
                own = np.append(ids[first[r]:first[r + 1]], np.uint32(END_ID)).astype("<u4")
                for begin in range(0, len(own), SEQUENCE):
                    piece = own[begin:begin + SEQUENCE]
                    row.append(r), start.append(begin), length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes())), total.append(len(own))
            item, sizes = bundles(np.array(length, np.int64))
            kind = (sizes + UNIT - 1) // UNIT
            order = np.argsort(kind, kind="stable")
            inside = np.empty(len(kind), np.int64)
            inside[order] = np.arange(len(kind)) - np.searchsorted(kind[order], kind[order])
            rank = (seen[kind] + inside)[item]
            seen += np.bincount(kind, minlength=CLASSES + 1)
            lead = np.append(True, item[1:] != item[:-1]) if len(item) else np.zeros(0, bool)
            kind = kind[item]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.batch.column(0).take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()), "class": pa.array(kind.astype(np.int32)),
                "part": pa.array(np.full(len(kind), partition, np.int32)), "rank": pa.array(rank),
                "lead": pa.array(lead)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long, "
        "lead boolean")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row for each piece with its sequence_id and its offset there; `tokenizer` is a path on every executor."""
    cut = freeze(pieces(docs, key, text, tokenizer))  # partitions and ranks are fixed from here on
    counts = cut.filter("lead").groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    table = plan(histogram)
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence = np.zeros(len(kind), np.int64)
            for c in np.unique(kind):
                own, segments = kind == c, table[int(c)]
                begin, copies, first = segments[np.searchsorted(segments[:, 0], rank[own], "right") - 1].T
                sequence[own] = first + (rank[own] - begin) // copies
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence)],
                                             [*batch.schema.names[:5], "sequence_id"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = cut.schema["doc_id"].dataType.simpleString()
    placed = ranked.select(*names, "class", "rank").mapInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    # A sequence holds at most SEQUENCE pieces, so this window never holds more rows than that.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
