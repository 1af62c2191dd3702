"""LM scoring: smoothed word frequencies of the whole corpus, and a gated recurrent network over them.

Texts are encoded once, in blocks of some megabytes with their own dictionaries, and written to the shared folder.
Word counts come from all training texts (those whose crc32 of the id is not 0 modulo 10) by a grouped sum. The
`SYMBOLS` symbols of the network are the most frequent words and, for the others, the last byte of the word; within
such a class a word has its share of the smoothed frequency, so the network's probabilities sum to one over words
too. The network is warmed up on one block, then every partition trains on all its training texts from there and the
parameters are averaged by tokens (a grouped sum of fixed size). Scoring joins the counts to the blocks' dictionaries,
not to every token, and runs over whole texts with the state carried along.

Null and empty texts are their end token alone. A row without an id counts as training text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm import gru
from grainmill.llm.scratch import freeze
from grainmill.llm.text import LOWER, Words, give_back, hold, slices

BLOCK_BYTES = 12 << 20
END = np.uint64(0x656E645F746F6B65)  # the end token's place among word hashes
TAILS = gru.SIDE
HEAD = gru.SYMBOLS - TAILS
LEAST_UPDATES, MOST_ROUNDS = 300, 8


def encode(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each block: ids, held_out, sizes (tokens of each text), tokens, words, endings, counts."""
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 10 == 0, F.lit(False))
    source = docs.select(F.col(key).alias("doc"), held.alias("held"), F.col(text).alias("text"))

    def close(block: int, parts: list[tuple]) -> pa.RecordBatch:
        base = np.concatenate(([0], np.cumsum([len(p[2]) for p in parts])))
        words, back = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        endings = np.zeros(len(words), np.uint8)
        endings[back] = np.concatenate([p[3] for p in parts])
        tokens = np.concatenate([back[p[4] + b] for p, b in zip(parts, base[:-1], strict=True)]).astype(np.int32)
        # Frequent words get small numbers: their high bytes are zeros and compress well.
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        tokens, words, endings = rank[tokens], words[order], endings[order]
        sizes = np.concatenate([p[5] for p in parts]).astype(np.int32)
        held = np.concatenate([p[1] for p in parts])
        counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words)).astype(np.int32)
        ids = pa.chunked_array([p[0] for p in parts]).combine_chunks()
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            **{n: pa.array([squeeze(v)], pa.binary()) for n, v in (
                ("held", held), ("sizes", sizes), ("tokens", tokens), ("words", words), ("endings", endings),
                ("counts", counts))}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        block, parts, size = TaskContext.get().partitionId() << 24, [], 0
        for part in slices(batches, "text"):
            words = Words(part.data, part.offsets)
            hashes = np.full(len(words.row) + part.rows, END)
            endings = np.zeros(len(hashes), np.uint8)
            places = np.arange(len(words.row)) + words.row  # an end token follows each text
            hashes[places] = words.hashes(LOWER[part.data])
            endings[places] = LOWER[part.data][words.ends - 1]
            distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            parts.append((part.batch.column(0), part.column("held").astype(bool), distinct, endings[at], back,
                          words.counts + 1))
            size += len(part.data)
            if size >= BLOCK_BYTES:
                yield close(block, parts)
                block, parts, size = block + 1, [], 0
        if parts:
            yield close(block, parts)

    kind = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"block long, ids array<{kind}>, held binary, sizes binary, tokens binary, "
                                  "words binary, endings binary, counts binary")


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, the first bytes of all values first, then the second and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(batch: pa.RecordBatch, name: str, kind: type, row: int) -> np.ndarray:
    """The array that `squeeze` made of one column of one row."""
    held = memoryview(batch.column(batch.schema.get_field_index(name))[row].as_buffer())
    size = int.from_bytes(held[:8], "little")
    planes = pa.decompress(held[8:], size, codec="zstd", asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def dictionary(blocks: DataFrame) -> DataFrame:
    """(block, place, word, ending, own): the words of each block with their counts in its training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words = unpack(batch, "words", np.int64, r)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(words), batch.column(0)[r].as_py())),
                    "place": pa.array(np.arange(len(words), dtype=np.int32)), "word": pa.array(words),
                    "ending": pa.array(unpack(batch, "endings", np.uint8, r).astype(np.int16)),
                    "own": pa.array(unpack(batch, "counts", np.int32, r).astype(np.int64))})

    return blocks.select("block", "words", "endings", "counts").mapInArrow(
        run, "block long, place int, word long, ending short, own long")


class Vocabulary:
    """What scoring needs to know of the corpus, of fixed size: totals, frequent words, mass of the endings."""

    def __init__(self, n: int, v: int, head: np.ndarray, masses: np.ndarray):
        self.n, self.v, self.masses = n, v, masses
        order = np.argsort(head)
        self.head, self.head_symbols = head[order], order
        found = np.searchsorted(self.head, END.view(np.int64)) if len(head) else 0
        known = found < len(head) and self.head[found] == END.view(np.int64)
        self.begin = int(self.head_symbols[found]) if known else HEAD

    def symbols(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Symbol of each word: frequent words by rank, the rest by ending."""
        out = HEAD + endings.astype(np.int64) % TAILS
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
            out = np.where(self.head[at] == words, self.head_symbols[at], out)
        return out

    def frequency(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.n + 0.1 * (self.v + 1))


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, ending, n) of every word of the training texts."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    mass = np.zeros((TAILS, 2))
    for r in counts.groupBy((F.col("ending") % TAILS).alias("tail")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        mass[r.tail] = r.n, r.words
    for r in head:
        mass[r.ending % TAILS] -= (r.n, 1)
    # Each class has room for its words and one unseen word.
    masses = (mass[:, 0] + 0.1 * (mass[:, 1] + 1)) / (n + 0.1 * (v + 1))
    return Vocabulary(n, v, np.array([r.word for r in head], np.int64), masses)


def training_rows(batch: pa.RecordBatch, row: int, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a block's training texts in a row, and where texts begin."""
    table = known.symbols(unpack(batch, "words", np.int64, row), unpack(batch, "endings", np.uint8, row))
    sizes, held = unpack(batch, "sizes", np.int32, row), unpack(batch, "held", bool, row)
    symbols = table[unpack(batch, "tokens", np.int32, row)][np.repeat(~held, sizes)]
    starts = np.zeros(len(symbols), bool)
    starts[(np.cumsum(sizes[~held]) - sizes[~held])] = True
    return symbols, starts


def train_network(blocks: DataFrame, known: Vocabulary) -> np.ndarray:
    """Warm-up on one block, then one pass of every partition over all its blocks; the mean of what they learned."""
    used = blocks.select("block", "held", "sizes", "tokens", "words", "endings")

    def tuned(start: np.ndarray, rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold()
            flat, tokens = start, 0
            for batch in batches:
                for r in range(batch.num_rows):
                    symbols, starts = training_rows(batch, r, known)
                    if len(symbols):
                        updates = len(symbols) / int(np.clip(len(symbols) // 4000, 8, 512)) / gru.WINDOW
                        rounds = int(np.clip(np.ceil(LEAST_UPDATES / updates), 1, MOST_ROUNDS))
                        flat = gru.train(flat, symbols, starts, known.begin, rounds, rate)
                        tokens += len(symbols)
            give_back()
            if tokens:
                yield pa.RecordBatch.from_pydict({
                    "place": pa.array(np.arange(gru.SIZE, dtype=np.int32)),
                    "value": pa.array(flat.astype(np.float64) * tokens), "tokens": pa.array(np.full(gru.SIZE, tokens))})

        return run

    def mean(rows: DataFrame, run, otherwise: np.ndarray) -> np.ndarray:
        found = (rows.mapInArrow(run, "place int, value double, tokens long").groupBy("place")
                 .agg((F.sum("value") / F.sum("tokens")).alias("value")).toArrow().sort_by("place"))
        return found["value"].to_numpy().astype(np.float32) if found.num_rows else otherwise

    first = used.orderBy("block").limit(1)
    warm = mean(first, tuned(gru.initial(), 0.02), gru.initial())
    return mean(used, tuned(warm, 0.005), warm)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    blocks = freeze(encode(docs, key, text))
    words = dictionary(blocks)
    counts = freeze(words.filter("own > 0").groupBy("word", "ending").agg(F.sum("own").alias("n")))
    known = learn_vocabulary(counts)
    flat = train_network(blocks, known)
    # Only what a block does not know itself goes back to it: counts that other blocks add to.
    outside = (words.select("block", "place", "word", "own").join(counts.select("word", "n"), "word")
               .filter("n != own").select("block", "place", "n"))
    kind = docs.schema[key].dataType.simpleString()

    def judge(block: pa.Table, more: pa.Table) -> pa.Table:
        hold()
        outs = []
        for batch in block.combine_chunks().to_batches():
            for r in range(batch.num_rows):
                total = unpack(batch, "counts", np.int32, r).astype(np.int64)
                total[more["place"].to_numpy()] = more["n"].to_numpy()
                sizes, tokens = unpack(batch, "sizes", np.int32, r), unpack(batch, "tokens", np.int32, r)
                symbol = known.symbols(unpack(batch, "words", np.int64, r), unpack(batch, "endings", np.uint8, r))
                frequency = known.frequency(total)
                tail = symbol >= HEAD
                share = np.where(tail, np.log(frequency / known.masses[np.where(tail, symbol - HEAD, 0)]), 0)
                first = np.concatenate(([0], np.cumsum(sizes)))
                add = lambda v: np.add.reduceat(v[tokens], first[:-1]) if len(tokens) else np.zeros(0)
                network = gru.score(flat, symbol[tokens], first, known.begin)
                outs.append(pa.Table.from_pydict({
                    "doc_id": batch.column(batch.schema.get_field_index("ids"))[r].values,
                    "held_out": pa.array(unpack(batch, "held", bool, r)), "n_tokens": pa.array(sizes.astype(np.int64)),
                    "n_known": pa.array(add((total > 0).astype(np.int64))),
                    "train_tokens": pa.array(np.full(len(sizes), known.n, np.int64)),
                    "base_score": pa.array(add(np.log10(frequency))),
                    "score": pa.array((network + add(share)) / np.log(10))}))
        give_back()
        return pa.concat_tables(outs)

    schema = (f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double")
    # Every block comes with at least one row of its own, so that blocks without additions are scored too.
    return blocks.groupBy("block").cogroup(outside.groupBy("block")).applyInArrow(judge, schema)
