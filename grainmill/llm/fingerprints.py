"""Document fingerprints: a randomised edit embedding, sampled positions, bands of samples, and verification.

Embedding. A walker stands at the first character of a text. At step j it writes down the characters it stands at (a
hash of GRAM of them) and moves on by one if a random bit for (j, character) says so. All texts share these bits. Two
walkers in equal surroundings that are a few characters apart meet by chance and stay together, so a few edits change
a few of the written symbols: edit distance becomes Hamming distance. A walk takes two steps a character and begins
anew every BLOCK characters, so texts of any length are walked in bounded memory, and texts by the thousand in step.

Fingerprint. SAMPLES written symbols, one byte each. Sample s takes the position with the least random value of its
own among those a text has. Texts of the same length are so compared at the same positions; where one is longer, it has
a position of its own with a chance in proportion. Likeness is the share of equal samples: the Hamming similarity
of the embeddings, less what the lengths differ by. Its standard error is at most half of 1 / sqrt(SAMPLES).

Copies. A walk may fail to meet the other one, so WALKS of them are made, every other one from the end of the text.
Bands of samples name buckets; in a bucket the others are compared with one pivot after another until all that is left
lies in one component. Pairs whose likeness in one of the walks is high enough are verified by their exact edit distance.

Empty and null texts have the fingerprint of zeros; no other text has a zero, but for walks that end early. Rows are
ordered by id, then by a hash of the text; ids are taken to be nearly unique, and rows without an id come first. Rows
that repeat are texts like others. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.components import components
from grainmill.llm.scratch import freeze, store
from grainmill.llm.text import mix

SAMPLES, BLOCK, GRAM, CLASSES, WALKS = 128, 2048, 4, 256, 4
BAND_SIZE, BANDS = 4, 32
SLICE_CHARS = 1 << 20
PART_ROWS = 20_000
_RNG = np.random.default_rng(90210)
# Whether the walker of a walk at step j on a character of a class moves on; class 0 is the end of the text.
MOVES = _RNG.integers(0, 2, (WALKS, 2 * BLOCK, CLASSES), dtype=np.int32)
MOVES[:, :, 0] = 0


def sample_records(limit: int = 1 << 44) -> np.ndarray:
    """(SAMPLES, records): the positions at which each sample's least random value so far stands, ascending.

    The least of n random values stands at a later place than that of the first r with chance (n - r) / n, so the
    next record after position p is at (p + 1) / u for a uniform u; the values themselves are not needed.
    """
    rng = np.random.default_rng(31337)
    place, out = np.zeros(SAMPLES, np.int64), []
    while (place < limit).any():
        out.append(place)
        step = np.floor((place + 1) / (1 - rng.random(SAMPLES)))
        place = np.minimum(np.maximum(step, place + 1), 1 << 52).astype(np.int64)
    return np.stack([*out, place], axis=1)


RECORDS = sample_records()


def sampled_places(length: int) -> np.ndarray:
    """The position each sample takes among the `length` positions of an embedding, one or more."""
    return RECORDS[np.arange(SAMPLES), (RECORDS < length).sum(axis=1) - 1]


def walk(codes: np.ndarray, begins: np.ndarray, steps: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(steps, lanes) places of walkers that begin at `begins`; a lane's places after its `steps` are not set."""
    order = np.argsort(-steps, kind="stable")
    active = len(steps) - np.searchsorted(steps[order][::-1], np.arange(steps.max(initial=0)), "right")
    places = np.zeros((len(active), len(steps)), np.int32)
    at = begins[order].astype(np.int32)
    for j, lanes in enumerate(active.tolist()):
        now = at[:lanes]
        places[j, :lanes] = now
        now += moves[j].take(codes.take(now))
    out = np.empty_like(places)
    out[:, order] = places
    return out


def code_points(texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]


def fingerprints_of(points: list[np.ndarray], moves: np.ndarray = MOVES[0]) -> np.ndarray:
    """(texts, SAMPLES) bytes; texts that are too long for one slice are walked in parts."""
    out = np.zeros((len(points), SAMPLES), np.uint8)
    begin = 0
    while begin < len(points):
        end, total = begin, 0
        while end < len(points) and (end == begin or total + len(points[end]) <= SLICE_CHARS):
            total += len(points[end])
            end += 1
        if total <= SLICE_CHARS:
            _walk_texts(points[begin:end], 0, out[begin:end], moves)
        else:  # one long text: some blocks at a time, each with as many characters as its walk can reach
            for first in range(0, total, SLICE_CHARS):
                _walk_texts(points[begin:end], first, out[begin:end], moves)
        begin = end
    return out


def _walk_texts(points: list[np.ndarray], first: int, out: np.ndarray, moves: np.ndarray) -> None:
    """Fill in the samples that lie in the blocks from character `first` of each text on, up to SLICE_CHARS of them."""
    sizes = np.array([len(p) for p in points], np.int64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return
    reach = SLICE_CHARS + 2 * BLOCK + GRAM
    gap = np.zeros(GRAM, np.uint32)  # ends of texts: symbols never hold characters of the next text
    pieces = [x for k in filled for x in (points[k][first:first + reach], gap)]
    flat = np.concatenate(pieces)
    held = np.array([len(x) for x in pieces[::2]], np.int64)
    starts = np.concatenate(([0], np.cumsum(held + GRAM)))[:-1]
    codes = (mix(flat.astype(np.uint64)) % np.uint64(CLASSES - 1)).astype(np.uint8) + np.uint8(1)
    codes[flat == 0] = 0
    own = np.minimum(held, SLICE_CHARS) if sizes.max() > SLICE_CHARS else held
    lanes = -(-own // BLOCK)
    lane_first = np.concatenate(([0], np.cumsum(lanes)))
    lane_text = np.repeat(np.arange(len(filled)), lanes)
    block = np.arange(lane_first[-1]) - lane_first[lane_text]
    begins = starts[lane_text] + block * BLOCK
    places = walk(codes, begins, 2 * np.minimum(own[lane_text] - block * BLOCK, BLOCK), moves)
    for k, text in enumerate(filled.tolist()):
        wanted = sampled_places(2 * int(sizes[text])) - 2 * first
        here = np.flatnonzero((wanted >= 0) & (wanted < 2 * own[k]))
        at = places[wanted[here] % (2 * BLOCK), lane_first[k] + wanted[here] // (2 * BLOCK)]
        symbol = np.zeros(len(at), np.uint64)
        for g in range(GRAM):
            symbol = mix(symbol + flat[at + g] + np.uint64(g + 1))
        value = (symbol % np.uint64(255)).astype(np.uint8) + np.uint8(1)
        value[flat[at] == 0] = 0
        out[text, here] = value


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(axis=-1)


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text with its last half replaced by as much of the beginning of the following text."""
    half = len(points) // 2
    return np.concatenate((points[:len(points) - half], following[:half]))


FIELDS = ("doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")


def _report(ids: pa.Array, texts: list[np.ndarray], prints: np.ndarray, following: list[np.ndarray],
            next_prints: np.ndarray) -> dict:
    """Columns of FIELDS for texts and those that follow them."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    other = fingerprints_of(changed)
    return {"doc_id": ids, "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(c.tobytes().decode("utf-32-le", "surrogatepass").encode()).digest()
                                       for c in changed], pa.binary()),
            "fingerprint": pa.array([p.tobytes() for p in prints], pa.binary()),
            "edited_fingerprint": pa.array([p.tobytes() for p in other], pa.binary()),
            "near_edited": pa.array(likeness(prints, other)), "near_next": pa.array(likeness(prints, next_prints))}


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Texts are shuffled once, to ranges of ids; a task streams over its range in order. Where two ranges meet, the first
    and last rows are written down and put together afterwards: two rows a task.
    """
    source = docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    parts = max(1, -(-source.count() // PART_ROWS), int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = source.repartitionByRange(parts, "doc").sortWithinPartitions("doc", F.xxhash64("text"))
    edge = {"task": pa.int64(), "role": pa.string(), "text": pa.string(), "print": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        left: tuple | None = None  # (ids, text, print) of the last row so far

        def edges(role: str, ids: pa.Array, points: np.ndarray, made: np.ndarray) -> pa.RecordBatch:
            plain = {"doc_id": ids, **{f: pa.nulls(1, t) for f, t in (
                ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
                ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()))}}
            content = points.tobytes().decode("utf-32-le", "surrogatepass")
            values = {"task": [task], "role": [role], "text": [content], "print": [made.tobytes()]}
            return pa.RecordBatch.from_pydict(plain | {c: pa.array(values[c], t) for c, t in edge.items()})

        for batch in batches:
            for begin, end in _bounded(batch.column(1)):
                ids, points = batch.column(0).slice(begin, end - begin), code_points(batch.column(1).slice(begin, end - begin).to_pylist())
                prints = fingerprints_of(points)
                if left is None:
                    yield edges("first", ids.slice(0, 1), points[0], prints[0])
                else:
                    ids = pa.concat_arrays([left[0], ids])
                    points, prints = [left[1], *points], np.concatenate((left[2], prints))
                made = _report(ids.slice(0, len(points) - 1), points[:-1], prints[:-1], points[1:], prints[1:])
                made |= {c: pa.nulls(len(points) - 1, t) for c, t in edge.items()}
                yield pa.RecordBatch.from_pydict(made)
                left = ids.slice(len(points) - 1), points[-1], prints[-1:]
        if left is not None:
            yield edges("last", left[0], left[1], left[2][0])

    schema = FIELDS.format(kind=kind) + ", task long, role string, text string, print binary"
    rows = store(ordered.mapInArrow(run, schema))
    names = [f.split()[0] for f in FIELDS.format(kind=kind).split(", ")]
    met = _meet(rows.filter("role is not null"), kind)
    return rows.filter("role is null").select(names).unionByName(met).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next")


def _bounded(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of a batch with about SLICE_CHARS bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        base = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + SLICE_CHARS, "right")))
        yield begin, end
        begin = end


def _meet(edges: DataFrame, kind: str) -> DataFrame:
    """Rows of FIELDS for the last row of each task, followed by the first of the next task that has rows."""
    tasks = sorted(r.task for r in edges.filter("role = 'first'").select("task").collect())  # one number a task
    spark = edges.sparkSession
    following = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task long, next long")
    last = edges.filter("role = 'last'").select("task", "doc_id", "text", "print")
    first = edges.filter("role = 'first'").select(F.col("task").alias("next"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    pairs = last.join(following, "task").join(first, "next").select("doc_id", "text", "print", "next_text", "next_print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following_texts = (code_points(batch.column(k).to_pylist()) for k in (1, 3))
            prints, next_prints = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SAMPLES) for k in (2, 4))
            yield pa.RecordBatch.from_pydict(_report(batch.column(0), texts, prints, following_texts, next_prints))

    return pairs.mapInArrow(run, FIELDS.format(kind=kind))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_chars, print of all walks, bands: BANDS hashes of samples a walk, name: SHA-256) of every row."""
    source = docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _bounded(batch.column(1)):
                texts = batch.column(1).slice(begin, end - begin).to_pylist()
                points = code_points(texts)
                prints = np.stack([fingerprints_of([p[::-1] for p in points] if w % 2 else points, MOVES[w])
                                   for w in range(WALKS)], axis=1)
                names = np.broadcast_to(np.arange(1, WALKS * BANDS + 1, dtype=np.uint64), (len(texts), WALKS * BANDS))
                for k in range(BAND_SIZE):
                    names = mix(names * np.uint64(0x100000001B3)
                                + prints[:, :, k * BANDS:(k + 1) * BANDS].reshape(len(texts), -1))
                sizes = np.arange(0, names.size + 1, names.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column(0).slice(begin, end - begin), "n_chars": pa.array([len(p) for p in points], pa.int64()),
                    "print": pa.array([p.tobytes() for p in prints], pa.binary()),
                    "bands": pa.ListArray.from_arrays(pa.array(sizes), pa.array(names.ravel().view(np.int64))),
                    "name": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())})

    return source.mapInArrow(run, f"doc {kind}, n_chars long, print binary, bands array<long>, name binary")


def alike(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of (u, v, left, right) whose fingerprints reach the likeness in one walk."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, WALKS, SAMPLES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((likeness(left, right) >= least).any(axis=1)))

    return pairs.select("u", "v", "left", "right").mapInArrow(run, f"u {kind}, v {kind}")


def edit_distance(left: np.ndarray, right: np.ndarray, most: int) -> int:
    """The edit distance of two texts, or `most` + 1 if it is larger.

    On each diagonal stands the furthest place that so many edits reach; equal characters after it are free.
    """
    n, m = len(left), len(right)
    if abs(n - m) > most:
        return most + 1
    steps = np.arange(64)
    x = np.concatenate((left, np.full(len(steps), 0xFFFFFFFF, np.uint32)))  # the paddings differ from all and each other
    y = np.concatenate((right, np.full(len(steps), 0xFFFFFFFE, np.uint32)))
    far = np.full(2 * most + 3, -2, np.int64)
    for d in range(most + 1):
        low, high = max(-d, -n), min(d, m)
        own = slice(low + most + 1, high + most + 2)
        diagonal = np.arange(low, high + 1)
        if d:
            reach = np.maximum(np.maximum(far[own] + 1, far[own.start + 1:own.stop + 1] + 1), far[own.start - 1:own.stop - 1])
            reach = np.minimum(reach, np.minimum(n, m - diagonal))
        else:
            reach = np.zeros(1, np.int64)
        active = np.flatnonzero((reach >= 0) & (reach + diagonal >= 0))
        while len(active):
            at = reach[active]
            same = x[at[:, None] + steps] == y[(at + diagonal[active])[:, None] + steps]
            run = np.where(same.all(axis=1), len(steps), same.argmin(axis=1))
            reach[active] += run
            active = active[run == len(steps)]
        far[own] = reach
        if low <= m - n <= high and reach[m - n - low] == n:
            return d
    return most + 1


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of (u, v, left_text, right_text) that so many edits per 100 characters of the longer text join."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                left, right = code_points([a.as_py(), b.as_py()])
                most = max(len(left), len(right)) * percent // 100
                keep.append(edit_distance(left, right, most) <= most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "left_text", "right_text").mapInArrow(run, f"u {kind}, v {kind}")


def near_copies(docs: DataFrame, edits_percent: int = 5, least: float = 0.3, key: str = "doc_id", text: str = "text",
                ) -> DataFrame:
    """(doc_id, n_chars, component_id, n_links): texts linked by at most `edits_percent` edits per 100 characters.

    The percentage is of the longer text. Candidates agree in a band and reach `least` in likeness; the edit distance
    of each is then computed exactly. Equal texts are one from the start. n_links counts the verified links of a text,
    which are enough to join its component, not all that there are. Rows without an id or text are linked with nothing.
    """
    made = store(fingerprints(docs, key, text))
    single = store(made.filter("doc is not null and n_chars > 0").groupBy("name").agg(F.min("doc").alias("doc")))
    prints = made.join(single, ["name", "doc"], "left_semi").dropDuplicates(["doc", "name"])
    rows = prints.select(F.explode("bands").alias("bucket"), "doc")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = freeze(rows.join(shared, "bucket", "left_semi").select("bucket", "doc", F.col("doc").alias("component")))
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).dropDuplicates(["doc"])
    sides = [(prints.select(F.col("doc").alias(end), F.col("print").alias(side)),
              texts.select(F.col("doc").alias(end), F.col("text").alias(f"{side}_text")))
             for end, side in (("u", "left"), ("v", "right"))]
    links = None
    while members.take(1):
        pivots = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "doc").alias("h"), "doc", "component")).alias("p")) \
            .select("bucket", F.col("p.doc").alias("pivot"), F.col("p.component").alias("own"))
        pairs = (members.join(pivots, "bucket").filter("component != own")
                 .select(F.greatest("doc", "pivot").alias("u"), F.least("doc", "pivot").alias("v")).distinct())
        likely = alike(pairs.join(sides[0][0], "u").join(sides[1][0], "v"), least)
        found = verified(likely.join(sides[0][1], "u").join(sides[1][1], "v"), edits_percent)
        links = freeze(found if links is None else links.union(found).distinct())
        labels = components(links).select(F.col("u").alias("doc"), F.col("v").alias("label"))
        members = (members.join(pivots.select("bucket", F.col("pivot").alias("doc")), ["bucket", "doc"], "left_anti")
                   .join(labels, "doc", "left").select("bucket", "doc", F.coalesce("label", "component").alias("component")))
        mixed = (members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .filter("low != high").select("bucket"))
        members = freeze(members.join(mixed, "bucket", "left_semi"))
    group = single
    if links is not None:
        labels = components(links).select(F.col("u").alias("doc"), F.col("v").alias("label"))
        degree = links.select(F.explode(F.array("u", "v")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
        group = group.join(labels, "doc", "left").join(degree, "doc", "left")
    else:
        group = group.withColumns({"label": F.col("doc"), "n_links": F.lit(None).cast("long")})
    group = group.select("name", F.coalesce("label", "doc").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = F.col("doc").isNotNull() & (F.col("n_chars") > 0)
    return made.join(group, "name", "left").select(
        F.col("doc").alias("doc_id"), "n_chars", F.when(known, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
        F.when(known, F.col("n_links")).otherwise(0).alias("n_links"))
