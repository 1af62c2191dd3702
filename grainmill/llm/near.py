"""MinHash near-dedup with sequential Bayesian verification and exact links.

Signatures of 240 minima are cut into 40 bands of 6; rows that agree in a band are candidates. A pair at the
threshold is missed by all bands with probability 5e-6, one at 0.85 with 4e-9. Candidates are compared 24 minima at a
time, of which one byte each is kept; a pair goes as
soon as the posterior chance (uniform prior) that its similarity reaches the threshold falls below `MISS`.
Survivors are confirmed on their full shingle sets.

Equal sets are one representative from the start. Bands of `TINY` rows or fewer are compared in one round. In the
others every member first meets one other, the smallest of its bands; then for a few turns two members of the largest
component of a band; then pivots, all members outside that component, MOST_PIVOTS a round, meet all of other components.
Only then a pivot leaves its band, and a band whose members lie in one component is done, so that no pair that could
join two components stays unseen. Shingles that no other member has cannot be shared: a member with too few others is
compared with none, and a pivot only with those that the others of both allow. Groups of copies with edits of their
own are thereby told apart without their pairs (shared ones are bounded in each of PARTS parts of the hashes); pairs of members that share many edits, and no link, are all compared.

Rows without a word are linked with nothing. A row with a null id has a null component and is kept. Rows with the
same id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.components import components
from grainmill.llm.repeats import cell, cells_of
from grainmill.llm.scratch import Cells, bit, bitmap, discard, passed, store
from grainmill.llm.text import LOWER, Slice, Words, distinct_in_rows, gram_hashes, map_text, mix, rows_of, slices

BANDS, BAND_SIZE, STEP, MISS, TINY, MOST_PIVOTS, SAMPLED_TURNS = 40, 6, 24, 1e-6, 8, 128, 3
PARTS = 32  # a power of two
SIZE = BANDS * BAND_SIZE
_RNG = np.random.default_rng(7041)
_TIMES = _RNG.integers(1, 2**32, SIZE, dtype=np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 2**32, SIZE, dtype=np.uint32)


def shingle_sets(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row and each row's first place; short rows have one for all their words."""
    words = Words(part.data, part.offsets)
    hashes = words.hashes(LOWER[part.data])
    starts = words.gram_starts(size)
    values, row = gram_hashes(hashes, starts, size), words.row[starts]
    for few in range(1, size):
        short = np.flatnonzero(words.counts == few)
        values = np.concatenate((values, gram_hashes(hashes, words.first[:-1][short], few)))
        row = np.concatenate((row, short))
    order = np.argsort(row, kind="stable")
    return distinct_in_rows(values[order], row[order], part.rows)


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(doc, n_shingles, a, b: 128 bits of the set, minima: one byte each, bands: names) for every row."""
    def judge(part: Slice) -> dict:
        values, first = shingle_sets(part, size)
        counts = np.diff(first)
        filled = np.flatnonzero(counts)
        low, minima = (values >> np.uint64(32)).astype(np.uint32), np.zeros((part.rows, SIZE), np.uint32)
        if len(filled):
            at = first[filled]
            for k in range(SIZE):
                minima[filled, k] = np.minimum.reduceat(low * _TIMES[k] + _PLUS[k], at)
        names = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (part.rows, BANDS))
        for k in range(BAND_SIZE):
            names = mix(names * np.uint64(0x100000001B3) + minima[:, k * BANDS:(k + 1) * BANDS])
        out = {"n_shingles": counts, "minima": [m.tobytes() for m in minima.astype(np.uint8)],
               "bands": [m.tobytes() for m in names]}
        for name, salt in (("a", 1), ("b", 2)):
            sums = np.concatenate(([0], np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)))
            out[name] = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
        return out

    fields = {"n_shingles": "long", "a": "long", "b": "long", "minima": "binary", "bands": "binary"}
    return map_text(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "text", fields, judge, ["doc"])


def sets(docs: DataFrame, key: str, text: str, size: int, wanted: np.ndarray) -> DataFrame:
    """(doc, shingles: distinct 64-bit hashes) of rows whose id falls into a set cell; one worker passes over and cuts."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cells(sent.value)
        for part in slices((b.filter(pa.array(held[b.column(2).to_numpy()])) for b in batches), "text"):
            values, first = shingle_sets(part, size)
            yield pa.RecordBatch.from_pydict({"doc": part.batch.column(0), "shingles": pa.ListArray.from_arrays(
                pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), bit(F.col(key)).alias("cell")).mapInArrow(
        run, f"doc {kind}, shingles array<long>")


def bands(rows: DataFrame) -> DataFrame:
    """(bucket, doc): one row for each band of each signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(names),
                "doc": batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))})

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", "bands").mapInArrow(run, f"bucket long, doc {kind}")


def least_matches(percent: int) -> list[tuple[int, int]]:
    """(minima seen, matches needed) so that the posterior chance of reaching the threshold stays over MISS."""
    s = (np.arange(40000) + 0.5) / 40000
    out = []
    for seen in range(STEP, SIZE + 1, STEP):
        for matches in range(seen + 1):
            same = s + (1 - s) / 256  # bytes of different minima agree by chance
            log = matches * np.log(same) + (seen - matches) * np.log1p(-same)
            p = np.exp(log - log.max())
            if p[s >= percent / 100].sum() >= MISS * p.sum():
                out.append((seen, matches))
                break
    return out


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that the comparison of their minima, a batch at a time, does not rule out."""
    table = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIZE)
                           for k in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for seen, least in table:
                part = slice(seen - STEP, seen)
                matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield batch.select([0, 1]).take(pa.array(alive))

    kind = pairs.schema["u"].dataType.simpleString()
    return pairs.select("u", "v", "left", "right").mapInArrow(run, f"u {kind}, v {kind}")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity; row by row, as batches of sets of long texts are large."""
    both = F.size(F.array_intersect("left", "right"))
    return pairs.filter((100 + percent) * both >= percent * (F.size("left") + F.size("right"))).select("u", "v")


def beside(pairs: DataFrame, rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(u, v, left, right): `column` of both ends; rows of other documents are passed over before the shuffle.

    The second frame is what was stored on the way.
    """
    stored = store(pairs)
    ends = stored.select(F.col("u").alias("doc")).union(stored.select(F.col("v").alias("doc")))
    near = passed(rows.select("doc", column), "doc", bitmap(ends, "doc"), True)
    out = stored
    for end, name in (("v", "right"), ("u", "left")):
        out = out.join(near.select(F.col("doc").alias(end), F.col(column).alias(name)), end)
    return out.select("u", "v", "left", "right"), stored


def pivots_of(members: DataFrame) -> DataFrame:
    """(bucket, doc, component): members to compare with all others, outside the largest component of their bucket.

    They are all of these where they are MOST_PIVOTS at most, so that the bucket is done; else that many by a hash.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"),
                                      (F.sum("n") - F.max("n")).alias("outside"))
    out = members.join(top, "bucket").filter("component != main")
    crowd = (out.filter(F.col("outside") > MOST_PIVOTS)
             .groupBy("bucket", F.pmod(F.xxhash64("doc"), F.lit(MOST_PIVOTS)).alias("part"))
             .agg(F.min_by(F.struct("doc", "component"), "doc").alias("pivot")))
    few = out.filter(F.col("outside") <= MOST_PIVOTS).select("bucket", "doc", "component")
    return few.union(crowd.select("bucket", "pivot.doc", "pivot.component"))


def least_pairs(members: DataFrame) -> DataFrame:
    """(u, v), u > v: each member with one other, the smallest that any of its buckets holds."""
    least = members.groupBy("bucket").agg(F.min("doc").alias("v"))
    return (members.join(least, "bucket").groupBy(F.col("doc").alias("u")).agg(F.min("v").alias("v"))
            .filter("u > v"))


def sampled_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(u, v), u > v: members outside the largest component of a bucket with two members of such ones, by a hash."""
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    tagged = members.join(top, "bucket")
    order = F.xxhash64("bucket", "doc", F.lit(turn))
    chosen = (tagged.filter("component = main").groupBy("bucket", F.pmod(order, F.lit(2)).alias("part"))
              .agg(F.min_by("doc", order).alias("pivot")))
    hashed = F.xxhash64("pivot", "bucket", F.lit(turn))
    two = F.array(F.min_by("pivot", hashed), F.max_by("pivot", hashed))  # of all buckets of a member
    return (tagged.filter("component != main").select("bucket", "doc").join(chosen, "bucket")
            .groupBy("doc").agg(two.alias("pivots")).select("doc", F.explode("pivots").alias("pivot"))
            .select(F.greatest("doc", "pivot").alias("u"), F.least("doc", "pivot").alias("v")).distinct())


def common_shingles(members: DataFrame, full: DataFrame) -> DataFrame:
    """(doc, n, common: for each of PARTS parts of all hashes, the shingles that other members have too, or more).

    Members link with members only, so what a link shares are `common` shingles of both ends. Those are counted by
    the cells of a bitmap, which can only make them more.
    """
    sets = full.join(members.select("doc").distinct(), "doc", "left_semi")
    spread = (sets.select("doc", F.explode("shingles").alias("shingle")).groupBy("shingle")
              .agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low != high"))
    sent = full.sparkSession.sparkContext.broadcast(cells_of(spread, "shingle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cells(sent.value)
        for batch in batches:
            first = batch.column(1).offsets.to_numpy().astype(np.int64)
            names = batch.column(1).values.to_numpy().view(np.uint64)[first[0]:first[-1]]
            part = (names >> np.uint64(40)).astype(np.int64) % PARTS + PARTS * rows_of(first)
            counts = np.bincount(part[held[cell(names)]], minlength=PARTS * batch.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column(0), "n": pa.array(np.diff(first)), "common": pa.ListArray.from_arrays(
                    pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * PARTS), pa.array(counts))})

    return sets.select("doc", "shingles").mapInArrow(
        run, f"doc {full.schema['doc'].dataType.simpleString()}, n long, common array<int>")


def total(parts) -> Column:
    return reduce(add, (parts(k) for k in range(PARTS)))


def pivot_pairs(members: DataFrame, pivots: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(u, v), u > v: each pivot with the members of other components in its bucket that it can be similar to."""
    members = members.join(facts, "doc")
    pivots = pivots.join(facts, "doc").select("bucket", F.col("doc").alias("pivot"), F.col("component").alias("own"),
                                              F.col("n").alias("own_n"), F.col("common").alias("own_common"))
    most = total(lambda k: F.least(F.col("common")[k], F.col("own_common")[k]))
    return (members.join(pivots, "bucket").filter("component != own")
            .filter((100 + percent) * most >= percent * (F.col("n") + F.col("own_n")))
            .select(F.greatest("doc", "pivot").alias("u"), F.least("doc", "pivot").alias("v")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 4, key: str = "doc_id", text: str = "text",
                    ) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`; sets of `size`-word shingles."""
    made = store(signatures(docs, key, text, size))
    apart = store(made.filter("n_shingles > 0 and doc is not null").groupBy("a", "b", "n_shingles")
                  .agg(F.min("doc").alias("doc")))
    rows = bands(made.join(apart, ["a", "b", "n_shingles", "doc"], "left_semi"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    active = store(rows.join(shared, "bucket"))
    # Sets are made of the documents in shared buckets, and of the few others that fall into their bitmap's cells.
    full = store(sets(docs, key, text, size, bitmap(active, "doc")).dropDuplicates(["doc"]))

    tiny = active.filter(F.col("members") <= TINY)
    pairs = tiny.select("bucket", F.col("doc").alias("u")).join(
        tiny.select("bucket", F.col("doc").alias("v")), "bucket").filter("u > v").select("u", "v")
    members = active.filter(F.col("members") > TINY).select("bucket", "doc", F.col("doc").alias("component"))
    pivots = members.limit(0)
    pairs = pairs.union(least_pairs(members)).distinct()
    links, turn, facts = None, 0, None
    while True:
        # What a turn stored goes once what follows from it is stored.
        minima, first = beside(pairs, made, "minima")
        compared, second = beside(likely(minima, percent), full, "shingles")
        found = confirmed(compared, percent)
        before, links = links, components(found if links is None else links.union(found))
        discard(before, first, second)
        # The pivots leave; what is left matters where two components still meet.
        labels = links.select(F.col("u").alias("doc"), F.col("v").alias("label"))
        left = (members.join(pivots.select("bucket", "doc"), ["bucket", "doc"], "left_anti")
                .join(labels, "doc", "left").select("bucket", "doc", F.coalesce("label", "doc").alias("component")))
        mixed = (left.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .filter("low != high").select("bucket"))
        former, members = members, store(left.join(mixed, "bucket", "left_semi"))
        discard(former, pivots)
        if not members.take(1):
            break
        # A few links join most of what belongs together; only what is still apart then meets all pivots.
        turn += 1
        if turn == 1:
            # Who shares too few shingles with all others together is linked with none of them.
            facts = store(common_shingles(members, full))
            able = facts.filter(100 * total(lambda k: F.col("common")[k]) >= percent * F.col("n"))
            former, members = members, store(members.join(able, "doc", "left_semi"))
            discard(former)
        if turn <= SAMPLED_TURNS:
            pivots, pairs = members.select("bucket", "doc", "component").limit(0), sampled_pairs(members, turn)
        else:
            pivots = store(pivots_of(members))
            pairs = pivot_pairs(members, pivots, facts, percent)
    label = links.select(F.col("u").alias("same"), F.col("v").alias("label"))
    group = equal_ids(apart).join(label, "same", "left").select(
        "a", "b", "n_shingles", F.coalesce("label", "same").alias("component"))
    out = made.join(group, ["a", "b", "n_shingles"], "left")
    component = F.when(F.col("doc").isNull() | (F.col("n_shingles") == 0), F.col("doc")).otherwise(F.col("component"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id"),
                      component.eqNullSafe(F.col("doc")).alias("kept"))


def equal_ids(apart: DataFrame) -> DataFrame:
    return apart.select("a", "b", "n_shingles", F.col("doc").alias("same"))


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the documents that are not the smallest id of their component."""
    gone = near_duplicates(docs, percent, size, key, text).filter("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs[key] == F.col("gone"), "left_anti")
