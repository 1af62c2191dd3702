"""Suffix-array dedup with a run-length index: bytes covered by a long string that also starts elsewhere go.

1. Every window of `length` bytes has an anchor, its smallest hashed 32-byte gram (the leftmost of equals), so equal
   windows have equal anchors. Anchors that start twice or more in the corpus are the repetitive part of it.
2. Around each such anchor the bytes of its windows are cut out. Equal cuts are one row with a count; a count of two
   repeats all its windows. The rest is dealt by anchor over shards of a few megabytes.
3. A shard sorts the suffixes of its cuts, and keeps of the Burrows-Wheeler transform its runs with the suffixes
   sampled at the run heads and run ends. Match lengths with the neighbour in suffix order are computed at the samples
   only; streaming over a cut in text order gives all others, as a match inside a run is one shorter than the match of
   the place before it. A window whose longest match reaches `length` starts elsewhere too.
4. Anchors with more than HOT_CUTS different cuts would grow a shard; their windows are compared by 128-bit
   fingerprints in a grouped count instead, which needs no group in one place.

If two texts are equal, all bytes of one that has a window go. Null is an empty text. Ids name documents; rows without an id are judged like others, each by its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.repeats import cell, cells_of
from grainmill.llm.scratch import Cells, bitmap, passed, store
from grainmill.llm.text import BYTE_VALUES, Slice, buffers, mix, prefix_sums, rows_of, slices, span_hashes

LENGTH, GRAM, HOT_CUTS, SHARD_BYTES = 400, 32, 1500, 1 << 19
PART_BYTES = 1 << 19  # every byte of a slice has a dozen numbers while anchors are found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, from minima to both sides of block borders."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, name) of each anchor; windows are byte places of the slice."""
    gram = min(GRAM, length)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not sizes.any():
        return none, none, none, none.astype(np.uint64)
    place = np.arange(len(data) - gram + 1)
    names = span_hashes(prefix_sums(BYTE_VALUES[data]), place, place + gram)
    least = sliding_least((names & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64), length - gram + 1)
    del place
    first = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.arange(first[-1]) + np.repeat(offsets[:-1] - first[:-1], sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]))
    begin = np.flatnonzero(change)
    last = np.append(begin[1:], len(at)) - 1
    return row[begin], starts[begin], starts[last], names[at[begin]]


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(a, b, n, anchors): 128 bits and size of each text, and its anchors, repeated ones twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART_BYTES):
            row, _, _, name = anchors(part.data, part.offsets, length)
            cut = np.searchsorted(row, np.arange(part.rows + 1))
            lists = []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                own = np.sort(name[x:y])
                third = np.append([False, False], own[2:] == own[:-2])[:len(own)]  # two say as much as more
                lists.append(own[~third].view(np.int64))
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            a, b = text_names(part)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(a), "b": pa.array(b), "n": pa.array(np.diff(part.offsets)),
                "anchors": pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))})

    return texts.mapInArrow(run, "a long, b long, n long, anchors array<long>")


def text_names(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's bytes."""
    values = BYTE_VALUES[part.data]
    return tuple(span_hashes(prefix_sums(v), part.offsets[:-1], part.offsets[1:], part.data, salt).view(np.int64)
                 for salt, v in enumerate((values, mix(values))))


def cuts(texts: DataFrame, length: int, cells: np.ndarray) -> DataFrame:
    """(a, b, start, windows, anchor, cut) around the anchors that fall into a set cell; input is (text)."""
    sent = texts.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cells(sent.value)
        for part in slices(batches, "text", PART_BYTES):
            row, first, last, name = anchors(part.data, part.offsets, length)
            keep = held[cell(name)]
            row, first, last, name = row[keep], first[keep], last[keep], name[keep]
            raw, (a, b) = part.data.tobytes(), text_names(part)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(a[row]), "b": pa.array(b[row]),
                "start": pa.array(first - part.offsets[row]), "windows": pa.array(last - first + 1),
                "anchor": pa.array(name.view(np.int64)),
                "cut": pa.array([raw[x:y + length] for x, y in zip(first.tolist(), last.tolist(), strict=True)],
                                pa.binary())})

    return texts.mapInArrow(run, "a long, b long, start long, windows long, anchor long, cut binary")


def ranks_of(keys: np.ndarray) -> tuple[np.ndarray, bool]:
    """Dense rank of each key, and whether all keys differ."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(False, ordered[1:] != ordered[:-1])
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank, bool(new[1:].all())


def suffix_ranks(data: np.ndarray, row: np.ndarray, ends: np.ndarray, longest: int,
                 ) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix order of texts laid end to end (`ends` for each place), and equality ranks of the first 7, 21 ... bytes.

    Every text ends in a sign of its own, so suffixes are compared within their texts.
    """
    n = len(data)
    place = np.arange(n)
    code = np.zeros(n, np.uint64)
    for k in range(7):  # nine bits a byte: 0 stands for the end
        inside = place + k < ends
        code = (code << np.uint64(9)) | np.where(inside, data[np.minimum(place + k, n - 1)].astype(np.uint64) + np.uint64(1),
                                                np.uint64(0))
    signs = row + 1  # ends sort before all bytes, and differ from text to text from the second width on
    rank, _ = ranks_of(code)
    ranks, width, base = [(7, rank)], 7, int(row[-1]) + 2
    bits = int(n + base).bit_length()
    parts = 3 if 3 * bits <= 63 else 2  # ranks that fit into one key
    while width <= longest:
        key = rank.astype(np.int64)
        for k in range(1, parts):
            at = place + k * width
            # Past its end, a text has its sign; what follows the sign no longer matters.
            key = (key << bits) + np.where(at < ends, rank[np.minimum(at, n - 1)] + base, signs)
        rank, apart = ranks_of(key)
        width *= parts
        ranks.append((width, rank))
        if apart:
            break
    order = np.empty(n, np.int64)
    order[rank] = place
    return order, ranks


def match_lengths(left: np.ndarray, right: np.ndarray, data: np.ndarray, ends: np.ndarray,
                  ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Common prefix of pairs of suffixes: the widths of equal ranks, largest first and twice each, then single bytes."""
    begin, left, right = left, left.copy(), right.copy()
    last_left, last_right = ends[left], ends[right]
    for width, rank in [x for x in reversed(ranks) for _ in range(2)]:
        fits = (left + width <= last_left) & (right + width <= last_right)
        fits[fits] = rank[left[fits]] == rank[right[fits]]
        left, right = left + width * fits, right + width * fits
    fits = np.ones(len(left), bool)
    for _ in range(ranks[0][0]):
        fits &= (left < last_left) & (right < last_right)
        fits[fits] = data[left[fits]] == data[right[fits]]
        left, right = left + fits, right + fits
    return left - begin


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts laid end to end, with samples at run heads and run ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.row = rows_of(offsets)
        self.ends = offsets[1:][self.row]
        order, ranks = suffix_ranks(data, self.row, self.ends, int(np.diff(offsets).max()))
        first = np.zeros(len(data), bool)
        first[offsets[:-1]] = True
        before = np.where(first, -1, data[np.maximum(np.arange(len(data)) - 1, 0)].astype(np.int16))
        transform = before[order]
        head = np.append(True, (transform[1:] != transform[:-1]) | (transform[1:] < 0))
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(order)) - 1
        self.bytes, self.sizes = transform[heads], np.diff(np.append(heads, len(order)))
        self.head_places, self.tail_places = order[heads], order[tails]
        # Lengths at the samples: with the suffix before a run head, and with the one after a run end.
        lengths = match_lengths(order[tails[:-1]], order[heads[1:]], data, self.ends, ranks) if len(heads) > 1 \
            else np.zeros(0, np.int64)
        self.head_lengths, self.tail_lengths = np.append(0, lengths), np.append(lengths, 0)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of each place with any other suffix, streamed from the samples in text order."""
        place, best = np.arange(len(self.data)), np.zeros(len(self.data), np.int64)
        for places, lengths in ((self.head_places, self.head_lengths), (self.tail_places, self.tail_lengths)):
            reach = np.full(len(place), -1, np.int64)  # end of the match that began at the sample
            reach[places] = np.arange(len(place))[places]
            at = np.maximum.accumulate(np.where(reach >= 0, reach, -1))
            known = np.zeros(len(place), np.int64)
            known[places] = lengths
            streamed = np.where(at >= 0, known[at] - (place - at), 0)
            streamed = np.where((at >= 0) & (at >= self.offsets[self.row]), streamed, 0)
            best = np.maximum(best, streamed)
        return best


def shard_marks(length: int):
    """Function of one shard's rows: (ca, cb, offsets) with the windows of each cut that start elsewhere too."""
    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        data, offsets = buffers(batch.column(batch.schema.get_field_index("cut")))
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        lengths = RunIndex(data, offsets).matching_statistics()
        marked = np.flatnonzero(lengths >= length)
        row = np.searchsorted(offsets, marked, "right") - 1
        places = (marked - offsets[row]).astype(np.int32)
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        out = pa.Table.from_pydict({"ca": table["ca"].combine_chunks(), "cb": table["cb"].combine_chunks(),
                                    "offsets": pa.ListArray.from_arrays(pa.array(cut), pa.array(places))})
        return out.filter(pa.array(np.diff(cut) > 0))

    return run


def hot_rows(rows: DataFrame, length: int) -> DataFrame:
    """(ca, cb, offset, fa, fb): each window of the cuts with 128 bits of its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "cut", PART_BYTES):
            sizes = np.maximum(np.diff(part.offsets) - length + 1, 0)
            first = np.concatenate(([0], np.cumsum(sizes)))
            row = rows_of(first)
            starts = np.arange(first[-1]) + part.offsets[:-1][row] - first[:-1][row]
            values = BYTE_VALUES[part.data]
            fa, fb = (span_hashes(prefix_sums(v), starts, starts + length).view(np.int64) for v in (values, mix(values)))
            yield pa.RecordBatch.from_pydict({
                "ca": part.batch.column(0).take(pa.array(row)), "cb": part.batch.column(1).take(pa.array(row)),
                "offset": pa.array((starts - part.offsets[:-1][row]).astype(np.int32)),
                "fa": pa.array(fa), "fb": pa.array(fb)})

    return rows.select("ca", "cb", "cut").mapInArrow(run, "ca long, cb long, offset int, fa long, fb long")


def cut_run(length: int, kept: bool):
    """Function of batches: (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) from (doc, text, copy, spans)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART_BYTES):
            gone = np.zeros(len(part.data) + 1, np.int64)
            for r, (copy, spans) in enumerate(zip(part.batch.column(2).to_pylist(), part.batch.column(3), strict=True)):
                first, last = part.offsets[r], part.offsets[r + 1]
                if copy and last - first >= length:
                    gone[first] += 1
                    gone[last] -= 1
                elif spans.is_valid:
                    values = spans.values
                    begin = first + values.field("begin").to_numpy()
                    end = np.minimum(first + values.field("end").to_numpy(), last)
                    begin, end = begin[begin < end], end[begin < end]
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, end, -1)
            dropped = np.cumsum(gone)[:-1] > 0
            starts = dropped & ~np.append(False, dropped[:-1])[:len(dropped)]
            starts[part.offsets[:-1][part.offsets[:-1] < len(dropped)]] |= dropped[part.offsets[:-1][part.offsets[:-1] < len(dropped)]]
            total, spans = (np.concatenate(([0], np.cumsum(x)))[part.offsets] for x in (dropped, starts))
            left = [part.data[x:y][~dropped[x:y]].tobytes() for x, y in
                    zip(part.offsets[:-1], part.offsets[1:], strict=True)]
            columns = {"doc_id": part.batch.column(0), "n_bytes": pa.array(np.diff(part.offsets)),
                       "n_removed": pa.array(np.diff(total)), "n_spans": pa.array(np.diff(spans)),
                       "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left])}
            yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(left, pa.binary())} if kept else {}))

    return run


def cut_schema(docs: DataFrame, kept: bool) -> str:
    kind = docs.schema["doc"].dataType.simpleString()
    return f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text",
                          kept: bool = False, hot_cuts: int = HOT_CUTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; `kept` adds the bytes that remain."""
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    named = store(anchor_rows(texts.select("text"), length))
    group = named.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("copies"))
    spread = (named.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("seen"))
              .filter("seen > 1"))
    # Cuts are passed over by the cell of their anchor; what is repeated is decided below, exactly.
    found = store(cuts(texts.select("text"), length, cells_of(spread, "anchor"))
                  .withColumn("ca", F.xxhash64("cut")).withColumn("cb", F.xxhash64(F.lit("cut"), "cut")))
    different = store(found.groupBy("ca", "cb").agg(
        F.count(F.lit(1)).alias("seen"), F.first("anchor").alias("anchor"), F.first("cut").alias("cut")))
    crowd = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("cuts"), F.sum(F.length("cut")).alias("size"))
    crowd = store(crowd.filter("cuts > 1"))
    total = crowd.filter(F.col("cuts") <= hot_cuts).agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    alone = different.filter("seen = 1").join(crowd, "anchor", "left_semi")
    # Cuts move once, to their shards: an anchor of another kind that shares a cell only adds a cut that is not `alone`.
    near = passed(different, "anchor", bitmap(crowd.filter(F.col("cuts") <= hot_cuts), "anchor"), True)
    crowded = F.broadcast(crowd.filter(F.col("cuts") > hot_cuts).select("anchor"))  # one in `hot_cuts` cuts at most
    near = near.join(crowded, "anchor", "left_anti")
    indexed = (near.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "ca", "cb", "cut")
               .groupBy("shard").applyInArrow(shard_marks(length), "ca long, cb long, offsets array<int>"))
    hot = hot_rows(different.join(crowded, "anchor", "left_semi"), length)
    twice = hot.groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fa", "fb")
    compared = hot.join(twice, ["fa", "fb"], "left_semi").groupBy("ca", "cb").agg(F.collect_set("offset").alias("offsets"))
    marks = indexed.unionByName(compared).join(alone.select("ca", "cb"), ["ca", "cb"], "left_semi")
    repeated = different.filter("seen > 1").select("ca", "cb", F.lit(None).cast("array<int>").alias("offsets"))
    spans = found.select("a", "b", "start", "windows", "ca", "cb").join(marks.unionByName(repeated), ["ca", "cb"])
    # Runs of marked windows become spans: a window opens one if the window before it is not marked.
    opened = F.array_except("offsets", F.transform("offsets", lambda x: x + 1))
    closed = F.array_except("offsets", F.transform("offsets", lambda x: x - 1))
    pieces = F.when(F.col("offsets").isNull(), F.array(F.struct(
        F.col("start").alias("begin"), (F.col("start") + F.col("windows") - 1 + length).alias("end")))) \
        .otherwise(F.zip_with(F.array_sort(opened), F.array_sort(closed), lambda x, y: F.struct(
            (F.col("start") + x).alias("begin"), (F.col("start") + y + length).alias("end"))))
    spans = (spans.select("a", "b", pieces.alias("spans")).distinct()  # copies of a text give the same
             .groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    copies = group.filter("copies > 1").select("a", "b", F.lit(True).alias("copy"))
    facts = store(copies.join(spans, ["a", "b"], "full_outer"))
    cells = cells_of(facts, "a")
    # One worker a task names, passes over and, for texts that lose nothing, finishes the rows.
    sent = texts.sparkSession.sparkContext.broadcast(cells)
    schema, cut = cut_schema(texts, kept), cut_run(length, kept)
    touched = texts.mapInArrow(split_run(sent, True), name_schema(texts)).join(facts, ["a", "b"], "left")
    touched = touched.select("doc", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    rest = split_run(sent, False)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rest(batches):
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column(0), "text": batch.column(1),
                "copy": pa.array(np.zeros(batch.num_rows, bool)), "spans": pa.nulls(batch.num_rows)})

    return touched.mapInArrow(cut, schema).unionByName(texts.mapInArrow(lambda batches: cut(whole(batches)), schema))


def split_run(sent, present: bool):
    """Function of (doc, text) batches: (doc, text, a, b) of rows whose `a` falls into a set (or clear) cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cells(sent.value)
        for batch in named_run(batches):
            yield batch.filter(pa.array(held[cell(batch.column(2).to_numpy().view(np.uint64))] == present))

    return run


def name_schema(texts: DataFrame) -> str:
    return f"doc {texts.schema['doc'].dataType.simpleString()}, text string, a long, b long"


def named_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the 128 bits of each text."""
    for part in slices(batches, "text", PART_BYTES):
        a, b = text_names(part)
        yield pa.RecordBatch.from_pydict({"doc": part.batch.column(0), "text": part.batch.column(1),
                                          "a": pa.array(a), "b": pa.array(b)})
