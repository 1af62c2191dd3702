"""Substring dedup by recompression: words that repeat a window of an earlier document go.

Every document is a sequence of word symbols. A round replaces runs of equal symbols, then pairs of a left and a
right symbol (a bit of the symbol's hash), by new symbols. A new symbol's name is a hash of what it stands for, so
that all tasks give the same name without a shuffle, and equal substrings get the same symbols except near their
ends. Each symbol carries the interval of words that decided it; a symbol is consistent in a window if that interval
lies inside. A window's anchor is the smallest of its consistent symbols on the highest level that has one (level 0,
the words, always does), so equal windows have equal anchors.

Spark then names what is shared, in rounds: an anchor, or a run of GRAM words chosen by its hash, matters if two
different texts have it; windows with one that does not are in no other text. Runs of windows with
such an anchor are named by all their words, and equal runs keep one document, the smallest. Where an anchor has
different runs, the windows of those documents get 95-bit fingerprints, whose smallest document decides. Equal texts
are one from the start. A hot passage is a few hot keys of pre-aggregated minima; nothing is gathered by key.

A word goes if a window of `window` words that covers it also starts in a document with a smaller id. Null and empty
texts have no words. Rows without an id are neither shortened nor count as earlier. Ids name documents: repeated rows
with the same id and text are treated alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.scratch import BITS, Cells, bitmap, folded, passed, store
from grainmill.llm.text import Slice, Words, mix, prefix_sums, slices, span_hashes

WINDOW, LEVELS, GRAM, ONE_IN = 50, 5, 16, 10
_M = np.uint64(0x9E3779B97F4A7C15)


class Level:
    """Symbols of one level: name, row, the interval [lo, hi) of words that decided each, and its first word."""

    def __init__(self, name: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray):
        self.name, self.row, self.lo, self.hi, self.first = name, row, lo, hi, first


def merge(level: Level, head: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Level:
    """A level of groups of neighbours; `head` begins each group, the rest is given for each symbol."""
    at = np.flatnonzero(head)
    return Level(name[at], level.row[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), level.first[at])


def runs(level: Level, border: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> Level:
    """Name the runs of equal symbols; a run, also of one symbol, is decided by its symbols and both neighbours.

    A neighbour whose word next to a single symbol is not the symbol's word at its other end differs from it, whatever
    else it holds: that one word is enough. Otherwise the whole neighbour has to be known.
    """
    n = len(level.name)
    if n == 0:
        return level
    same = (level.name[1:] == level.name[:-1]) & (level.row[1:] == level.row[:-1])
    head = np.append(True, ~same)
    group = np.cumsum(head) - 1
    size = np.bincount(group)
    long = (size > 1)[group]
    lo, hi = level.lo.copy(), level.hi.copy()
    at = np.flatnonzero(head)
    last = np.append(at[1:], n) - 1
    end = np.append(level.first[1:], len(hashes))  # after the last word of each symbol
    before, begins, ends = hashes[level.first[at] - 1], hashes[level.first[at]], hashes[end[last] - 1]
    inside = (at > 0) & (level.row[at - 1] == level.row[at])
    left = np.where(inside, level.lo[at - 1], border[0][level.row[at]])
    lo[at] = np.where((size > 1) | ~inside | (before == ends), left, np.minimum(lo[at], level.first[at] - 1))
    after = np.minimum(last + 1, n - 1)
    inside = (last < n - 1) & (level.row[after] == level.row[last])
    right = np.where(inside, level.hi[after], border[1][level.row[last]])
    follows = hashes[np.minimum(end[last], len(hashes) - 1)]
    hi[last] = np.where((size > 1) | ~inside | (follows == begins), right, np.maximum(hi[last], end[last] + 1))
    name = np.where(long, mix(level.name * _M + size[group].astype(np.uint64)), level.name)
    return merge(level, head, name, lo, hi)


def pairs(level: Level, border: tuple[np.ndarray, np.ndarray], salt: int) -> Level:
    """Name each left symbol with the right symbol after it; a symbol that stays alone is decided with a neighbour."""
    n = len(level.name)
    left = (mix(level.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    follows = np.append(level.row[1:] == level.row[:-1], False)  # a symbol of the same row comes next
    joined = np.append(left[:-1] & ~left[1:], False) & follows
    second = np.append(False, joined[:-1])
    lo, hi = level.lo.copy(), level.hi.copy()
    alone = left & ~joined
    hi[alone] = np.where(follows, np.append(level.hi[1:], 0), border[1][level.row])[alone]
    alone = ~left & ~second
    precedes = np.append(False, follows[:-1])
    lo[alone] = np.where(precedes, np.append(0, level.lo[:-1]), border[0][level.row])[alone]
    after = np.append(level.name[1:], np.uint64(0))
    name = np.where(joined, mix(level.name * _M ^ mix(after + np.uint64(salt))), level.name)
    return merge(level, ~second, name, lo, hi)


def least_in_ranges(name: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of name[begin:end] for each range that is not empty, from minima over powers of two."""
    out = np.zeros(len(begin), np.uint64)
    size = end - begin
    table, width = name, 1
    while True:
        own = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(own):
            out[own] = np.minimum(table[begin[own]], table[end[own] - width])
        if not (size >= 2 * width).any():
            return out
        table, width = np.minimum(table[:-width], table[width:]), 2 * width


def anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts (word indexes of the slice) and the anchor of each window."""
    starts = words.gram_starts(window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    n = len(hashes)
    border = words.first[:-1] - 1, words.first[1:] + 1
    place = np.arange(n)
    level = Level(hashes, words.row, place, place + 1, place)
    found, missing = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    levels = [level]
    for k in range(LEVELS):
        level = pairs(runs(level, border, hashes), border, 2 * k + 1)
        levels.append(level)
    for k, level in reversed(list(enumerate(levels))):
        ask = starts[missing]
        if not len(ask):
            break
        begin = np.cumsum(np.bincount(np.maximum(level.lo + 1, 0), minlength=n + 2))[ask]  # symbols with lo < start
        end = np.cumsum(np.bincount(np.minimum(level.hi, n + 1), minlength=n + 2))[ask + window]
        some = end > begin
        at = np.flatnonzero(missing)[some]
        found[at] = mix(least_in_ranges(mix(level.name), begin[some], end[some]) + np.uint64(k))
        missing[at] = False
    return starts, found


def chosen_grams(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the runs of GRAM words whose hash is divisible by ONE_IN: content chooses them."""
    size = min(GRAM, window)
    places = words.gram_starts(size)
    names = span_hashes(prefix_sums(mix(hashes + np.uint64(61))), places, places + size)
    own = names % np.uint64(ONE_IN) == 0
    return places[own], mix(names[own])


def window_prints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of words; 64 and 31 bits of them are kept."""
    return tuple(span_hashes(prefix_sums(mix(hashes + np.uint64(salt))), starts, ends, hashes, salt) for salt in (11, 23))


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(doc, n, a, b, anchors): size, 128 bits and the distinct anchors of each text; input is (doc, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.data, part.offsets)
            hashes = words.hashes(part.data)
            starts, found = anchors(words, hashes, window)
            a, b = (span_hashes(prefix_sums(mix(hashes + np.uint64(s))), words.first[:-1], words.first[1:], hashes, s)
                    for s in (31, 47))
            change = np.ones(len(found), bool)
            row = words.row[starts]
            change[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            places, grams = chosen_grams(words, hashes, window)
            found, row = np.append(found[change], grams), np.append(row[change], words.row[places])
            order = np.argsort(row, kind="stable")
            found, row = found[order], row[order]
            cut = np.searchsorted(row, np.arange(part.rows + 1))
            lists = [np.unique(found[x:y]).view(np.int64) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc": part.batch.column(0), "n": pa.array(words.counts.astype(np.int64)),
                "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)),
                "anchors": pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))})

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, n long, a long, b long, anchors array<long>")


def sharing(named: DataFrame, cells: np.ndarray) -> DataFrame:
    """(doc) of the texts that have an anchor in a set cell; in no other text a window can be kept."""
    sent = named.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cells(sent.value)
        for batch in batches:
            first = batch.column(1).offsets.to_numpy().astype(np.int64)
            own = held[cell(batch.column(1).values.to_numpy().view(np.uint64)[first[0]:first[-1]])]
            found = np.diff(np.concatenate(([0], np.cumsum(own)))[first - first[0]]) > 0
            yield batch.select([0]).filter(pa.array(found))

    return named.select("doc", "anchors").mapInArrow(run, f"doc {named.schema['doc'].dataType.simpleString()}")


def marked_slices(batches: Iterator[pa.RecordBatch], held: Cells) -> Iterator[Slice]:
    """Slices of the rows whose mark, a hash of their document, falls into a set cell."""
    return slices((b.filter(pa.array(held[cell(b.column(2).to_numpy().view(np.uint64))])) for b in batches), "text")


def region_rows(docs: DataFrame, window: int, cells: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(doc, start, windows, anchor, ra, rb, name): the runs of windows with one anchor, for anchors in set cells.

    ra and rb are hashes of all words of the run's windows; name is that of this run in this document. Input is
    (doc, text, mark), with mark a hash of doc; rows whose mark has a clear cell in `wanted` are passed over.
    """
    sent = docs.sparkSession.sparkContext.broadcast((cells, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = map(Cells, sent.value)
        for part in marked_slices(batches, some):
            words, hashes, starts, last, found = regions(part, window, held)
            ra, rb = window_prints(hashes, starts, last + window)
            row = words.row[starts]
            yield pa.RecordBatch.from_pydict({
                "doc": part.batch.column(0).take(pa.array(row)),
                "start": pa.array((starts - words.first[row]).astype(np.int32)),
                "windows": pa.array((last - starts + 1).astype(np.int32)), "anchor": pa.array(found.view(np.int64)),
                "ra": pa.array(ra.view(np.int64)), "rb": pa.array((rb & np.uint64(0x7FFFFFFF)).astype(np.int32)),
                "name": pa.array(region_names(part, words, starts, ra).view(np.int64))})

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, start int, windows int, anchor long, ra long, rb int, name long")


def regions(part: Slice, window: int, held: Cells,
            ) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and first window, last window and anchor of the runs of windows with one anchor.

    Left out are windows whose anchor, or one of whose chosen grams, has a clear cell: no other text has it.
    """
    words = Words(part.data, part.offsets)
    hashes = words.hashes(part.data)
    starts, found = anchors(words, hashes, window)
    places, grams = chosen_grams(words, hashes, window)
    alone = np.zeros(len(hashes) + 1, np.int32)
    alone[places[~held[cell(grams)]] + 1] = 1
    alone = np.cumsum(alone)  # before each word
    keep = held[cell(found)] & (alone[starts + window - min(GRAM, window) + 1] == alone[starts])
    starts, found = starts[keep], found[keep]
    change = np.ones(len(found), bool)
    change[1:] = (found[1:] != found[:-1]) | (starts[1:] != starts[:-1] + 1) | (
        words.row[starts][1:] != words.row[starts][:-1])
    at = np.flatnonzero(change)
    return words, hashes, starts[at], starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts, found[at]


def region_names(part: Slice, words: Words, starts: np.ndarray, ra: np.ndarray) -> np.ndarray:
    mark = part.column("mark").view(np.uint64)
    return mix(ra ^ mix(mark[words.row[starts]]))


def window_rows(docs: DataFrame, window: int, cells: np.ndarray, named: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(doc, start, fa, fb) of the windows of runs (as in `region_rows`) whose name falls into a cell of `named`."""
    sent = docs.sparkSession.sparkContext.broadcast((cells, named, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, named, some = map(Cells, sent.value)
        for part in marked_slices(batches, some):
            words, hashes, starts, last, found = regions(part, window, held)
            ra, _ = window_prints(hashes, starts, last + window)
            keep = named[cell(region_names(part, words, starts, ra))]
            starts, size = starts[keep], (last - starts + 1)[keep]
            first = np.concatenate(([0], np.cumsum(size)))
            starts = np.arange(first[-1]) + np.repeat(starts - first[:-1], size)
            fa, fb = window_prints(hashes, starts, starts + window)
            row = words.row[starts]
            yield pa.RecordBatch.from_pydict({
                "doc": part.batch.column(0).take(pa.array(row)),
                "start": pa.array((starts - words.first[row]).astype(np.int32)), "fa": pa.array(fa.view(np.int64)),
                "fb": pa.array((fb & np.uint64(0x7FFFFFFF)).astype(np.int32))})

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, start int, fa long, fb int")


def cell(names: np.ndarray) -> np.ndarray:
    return (names % np.uint64(BITS)).astype(np.int64)


def cut_words(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) from (doc, text, copy, starts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.data, part.offsets)
            gone = np.zeros(len(words.row) + 1, np.int64)
            for r, (copy, starts) in enumerate(zip(part.batch.column(2).to_pylist(), part.batch.column(3), strict=True)):
                first, last = words.first[r], words.first[r + 1]
                if copy and last - first >= window:
                    gone[first] += 1
                    gone[last] -= 1
                elif starts.is_valid:
                    at = first + starts.values.field("start").to_numpy()
                    end = at + starts.values.field("windows").to_numpy() - 1 + window
                    at, end = at[end <= last], end[end <= last]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, end, -1)
            kept = np.cumsum(gone)[:-1] == 0
            raw, texts, removed = part.data.tobytes(), [], []
            for first, last in zip(words.first[:-1], words.first[1:], strict=True):
                own = np.flatnonzero(kept[first:last]) + first
                removed.append(int(last - first - len(own)))
                texts.append(b" ".join([raw[x:y] for x, y in zip(words.starts[own].tolist(), words.ends[own].tolist(),
                                                                 strict=True)]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.batch.column(0), "n_words": pa.array(words.counts.astype(np.int64)),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                "kept": pa.array([t.decode("utf-8") for t in texts])})

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row: kept words joined by one space."""
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    named = store(anchor_rows(texts, window))
    owned = named.filter("doc is not null")
    group = owned.groupBy("a", "b", "n").agg(F.min("doc").alias("doc"))
    spread = (owned.select("a", F.explode("anchors").alias("anchor"))
              .groupBy("anchor").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low != high"))
    # Rows are passed over by cells of fixed-size bitmaps; the grouped minima below are exact.
    marked = texts.filter("doc is not null").withColumn("mark", F.xxhash64("doc"))
    cells = cells_of(spread, "anchor")
    runs = store(region_rows(marked, window, cells, bitmap(sharing(owned, cells), "doc")))
    # Runs with equal words: all but the first document's go as a whole, and that one stands for them.
    contents = store(runs.groupBy("ra", "rb").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most"), F.min_by("name", "doc").alias("name"),
        F.min("anchor").alias("anchor")))
    whole = runs.join(contents.filter("least < most").select("ra", "rb", "least"), ["ra", "rb"]).filter("doc > least") \
        .select("doc", "start", "windows")
    # Where an anchor has runs with different words, the windows of their first documents are compared one by one.
    varied = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("anchor")
    compared = contents.join(varied, "anchor", "left_semi")
    windows = store(window_rows(marked, window, cells, cells_of(compared, "name"), bitmap(compared, "least")))
    least = (windows.groupBy("fa", "fb").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
             .filter("least < most").select("fa", "fb", "least"))
    single = windows.join(least, ["fa", "fb"]).filter("doc > least").select("doc", "start", F.lit(1).alias("windows"))
    starts = (whole.unionByName(single).groupBy("doc")
              .agg(F.collect_set(F.struct("start", "windows")).alias("starts")))
    copies = (owned.select("a", "b", "n", "doc")
              .join(group.withColumnRenamed("doc", "first"), ["a", "b", "n"]).filter("doc > first")
              .select("doc", F.lit(True).alias("copy")).distinct())
    facts = store(copies.join(starts, "doc", "full_outer"))
    cells = bitmap(facts, "doc")
    touched = passed(texts, "doc", cells, True).join(facts, "doc", "left")
    rest = passed(texts, "doc", cells, False).select(
        "doc", "text", F.lit(False).alias("copy"), F.lit(None).cast(facts.schema["starts"].dataType).alias("starts"))
    return cut_words(touched.select("doc", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
                     .unionByName(rest), window)


def cells_of(rows: DataFrame, column: str) -> np.ndarray:
    """Like `bitmap`, for hashes that tasks have at hand: the cell is the hash itself modulo BITS."""
    names = rows.select(F.pmod(F.col(column), F.lit(BITS)).alias("cell"))
    found = names.groupBy((F.col("cell") / 8).cast("int").alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("cell") % 8).cast("int"))).alias("flags")).toArrow()
    return folded(found)
