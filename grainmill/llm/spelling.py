"""Spelling variant grouping: words one edit apart, found by comparing dense tiles of padded code points.

Two words are one insertion, deletion or replacement apart exactly if their common prefix and suffix together reach
the longer length minus one. The first place where they differ, counted in the longer word, is the place of the edit.

1. Each word stands in the families of its own length and of the next one, as the longer or the shorter word of a
   pair, once for an edit in the first half of the longer word and once for the second. What lies outside that region
   is the same in both words and is the key of the row, so near words meet under one key.
2. Keys that more than CROWD rows share are split: the region is halved again, as often as needed. A region of one
   place has no more words than the alphabet has letters. Which keys are crowded is sent as a bitmap of fixed size.
3. Sorted by key, the words of a task are padded to the left and to the right into two matrices of code points, and
   blocks of rows are compared with each other where they share a key. A tile yields, per word, the number of near
   words and the best of them; the pairs themselves are never written.

A pair counts under the region that holds its place of edit, and under no other. A word's form has five times its
count at least, so the way from form to form is short, and roots are found by pointer doubling.

A null or empty text has no words. Repeated rows count each. The text of a document without an id is taken as it is.
Words of equal count: the smaller one in code-point order is the form. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.scratch import bitmap, freeze, passed, store
from grainmill.llm.text import slices

LEAST_LENGTH, LEAST_COUNT, FORM_TIMES, MARK = 6, 5, 5, 199
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # shorter runs never become words
HELD_WORDS = 100_000    # counts a task holds before it passes them on
CROWD, CROWD_BYTES = 2048, 1 << 24
TASK_ROWS = 50_000
TILE_CELLS, TILE_ROWS = 1 << 22, 128
NONE = np.iinfo(np.int64).max


def marked(doc: object, runs: Counter) -> Iterator[tuple[str, int]]:
    """The runs of a document with their counts; one code point is left out of those whose checksum says so."""
    start = None if doc is None else crc32(f"{doc}:".encode())
    for run, n in runs.items():
        if start is not None:
            h = crc32(run.encode(), start)
            if h % MARK == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < LEAST_LENGTH:
                    continue
        yield run, n


def vocabulary(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(word, n) of the words with `least` occurrences or more in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for part in slices(batches, "text"):
            ids = part.batch.column(0).to_pylist()
            for row in range(part.rows):
                lower = part.bytes_of(row).tobytes().lower().decode()  # bytes change A-Z alone
                for word, n in marked(ids[row], Counter(RUN.findall(lower))):
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD_WORDS:
                yield counts(held)
                held = {}
        yield counts(held)

    def counts(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()),
                                           "n": pa.array(list(held.values()), pa.int64())})

    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= least)


def with_key(rows: DataFrame) -> DataFrame:
    """`key` of (size, low, high): the characters outside the region from `low` to `high` of a word of that size."""
    before = F.substring("word", F.lit(1), F.col("low"))
    after = F.when(F.col("size") > F.col("high"), F.expr("right(word, size - high)")).otherwise("")
    return rows.select("word", "n", "size", "low", "high", F.xxhash64("size", "low", "high", before, after).alias("key"))


def halves(rows: DataFrame) -> DataFrame:
    """Every row twice, for the two halves of its region."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    both = F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high"))))
    return with_key(rows.select("word", "n", "size", both.alias("half")).select("word", "n", "size", "half.*"))


def keyed(words: DataFrame, crowd: int) -> DataFrame:
    """(word, n, size, low, high, key) with at most `crowd` rows a key, or regions of one place."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    rows = halves(words.select("word", "n", sizes).select("word", "n", "size", F.lit(0).alias("low"), F.col("size").alias("high")))
    done = None
    while True:
        full = rows.filter("high - low > 1").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
        full = freeze(full.filter((F.col("rows") > crowd) | ((F.col("bytes") > CROWD_BYTES) & (F.col("rows") > 2))).select("key"))
        if full.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cells = bitmap(full, "key")
        # All rows of a key fall into one cell, so a key is split as a whole or not at all.
        stay = passed(rows, "key", cells, False).unionByName(passed(rows.filter("high - low = 1"), "key", cells, True))
        done = stay if done is None else done.unionByName(stay)
        rows = store(halves(passed(rows.filter("high - low > 1"), "key", cells, True)))


def common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of `left` with every row of `right`."""
    same = np.ones((len(left), len(right)), bool)
    out = np.zeros(same.shape, np.int32)
    for k in range(left.shape[1]):
        same &= left[:, k, None] == right[None, :, k]
        if not same.any():
            break
        out += same
    return out


def near_in_tiles(words: list[bytes], size: int, low: np.ndarray, high: np.ndarray, key: np.ndarray, rank: np.ndarray,
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Number of near words and least rank among them; rows are sorted by key, words have `size` or one less letters."""
    prefix = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(-1, size)
    suffix = np.frombuffer(b"".join(w.rjust(size, b"\0")[::-1] for w in words), np.uint8).reshape(-1, size)
    longer = prefix[:, -1] != 0
    found, best = np.zeros(len(words), np.int64), np.full(len(words), NONE)
    step = int(max(1, min(TILE_ROWS, (TILE_CELLS // size) ** 0.5)))
    for a in range(0, len(words), step):
        i = slice(a, a + step)
        for b in range(a, len(words), step):
            j = slice(b, b + step)
            if b > a and key[b] != key[min(a + step, len(words)) - 1]:
                break
            begin = common(prefix[i], prefix[j])
            near = begin + common(suffix[i], suffix[j]) >= size - 1
            near &= (key[i, None] == key[None, j]) & (begin >= low[i, None]) & (begin < high[i, None])
            near &= longer[i, None] | longer[None, j]
            if a == b:
                np.fill_diagonal(near, False)
            found[i] += near.sum(axis=1)
            best[i] = np.minimum(best[i], np.where(near, rank[None, j], NONE).min(axis=1))
            if b > a:
                found[j] += near.sum(axis=0)
                best[j] = np.minimum(best[j], np.where(near, rank[i, None], NONE).min(axis=0))
    return found, best


def judged(table: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best) for the rows of whole keys, sorted by size and key, that have a near word."""
    key = table["key"].to_numpy()
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    table = table.filter(pa.array(same[1:] | same[:-1]))  # words alone under their key have nothing to meet
    size, low, high, key, n = (table[c].to_numpy() for c in ("size", "low", "high", "key", "n"))
    words = [w.encode("latin-1") for w in table["word"].to_pylist()]
    found, best = np.zeros(len(words), np.int64), np.full(len(words), NONE)
    order = np.lexsort((np.array(words, object), -n)) if len(words) else np.zeros(0, np.int64)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    edges = np.flatnonzero(np.diff(size, prepend=-1, append=-1)) if len(words) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        found[a:b], best[a:b] = near_in_tiles(words[a:b], int(size[a]), low[a:b], high[a:b], key[a:b], rank[a:b])
    hit = np.flatnonzero(found)
    chosen = order[best[hit]]
    return pa.RecordBatch.from_pydict({
        "word": table["word"].combine_chunks().take(pa.array(hit)), "n_near": pa.array(found[hit]),
        "best_n": pa.array(n[chosen]), "best": table["word"].combine_chunks().take(pa.array(chosen))})


def near_words(words: DataFrame, crowd: int) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have a near word."""
    rows = keyed(words, crowd)
    tasks = max(1, -(-4 * words.count() // TASK_ROWS))
    dealt = rows.repartition(tasks, "key").sortWithinPartitions("size", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if left is not None:
                table = pa.concat_tables([left, table])
            key = table["key"].to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0  # the last key may go on in the next batch
            if cut:
                yield judged(table.slice(0, cut))
            left = table.slice(cut).combine_chunks()
        if left is not None:
            yield judged(left)

    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form on the way from each word."""
    links = freeze(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = freeze(links.join(further, "root", "left").select("word", "root", "far"))
        links = jumped.select("word", F.coalesce("far", "root").alias("root"))
        if jumped.filter("far is not null").isEmpty():
            return links


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_COUNT,
                    times: int = FORM_TIMES, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `docs`."""
    words = store(vocabulary(docs, key, text, least))
    found = near_words(words, crowd)
    strong = F.col("best_n") >= times * F.col("n")
    rows = store(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")))
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
