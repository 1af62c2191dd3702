"""Quality rules: base counts, and a calibrated logistic regression over hashed words, word beginnings and n-grams.

Two heads share the features: `quality` keeps texts like the labelled good ones, `toxic` rejects texts like the
labelled toxic ones. Each is fitted on at most `sample_rows` labelled documents (those with the smallest hash of
their id), calibrated on a fold that the fit has not seen, and compared with a fixed probability. A head whose
labels are missing or all alike decides nothing. Everything else reads the whole of every text.

Compounds are rare words, so that few of them are seen twice; what they share is how they begin. The share of a
text's words with each beginning (letters A-Z in lower case) is a feature that does not shrink with the text.

Null and empty texts have no words and fail the base rule. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from grainmill.llm.text import (BYTE_VALUES, LOWER, Slice, Words, distinct_in_rows, give_back, gram_hashes,
                                gram_starts_of, map_text, mix, prefix_sums, row_sums, slices, span_hashes)

WORD_BUCKETS, PAIR_BUCKETS, CHAR_BUCKETS, CHAR_SIZE = 1 << 20, 1 << 18, 1 << 16, 4
BEGIN_BUCKETS, BEGIN_SIZES = 1 << 18, (5, 7)  # bytes of a word's beginning; a table of buckets each
GRAM_END = WORD_BUCKETS + PAIR_BUCKETS + CHAR_BUCKETS
BUCKETS = GRAM_END + BEGIN_BUCKETS * len(BEGIN_SIZES)
DENSE = 8.0  # scale of the frequency features (word pairs, characters) against the presence of words
BEGIN, BEGIN_WORDS = 25.0, 50  # scale of the beginnings' shares, and the fewest words they are shares of
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
QUALITY_AT_LEAST, TOXIC_BELOW = 0.5, 0.4
SAMPLE_ROWS = 4000
BLOCK = 1 << 20
# Rows that must have a feature, and the end of the buckets a head uses: with beginnings, or with rarer features, the
# quality head was wrong more often on unseen rows.
HEADS = {"quality": (6, GRAM_END), "toxic": (3, BUCKETS)}
FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
          "n_repeat_words": "long", "base_failed": "boolean", "p_quality": "double", "p_toxic": "double",
          "kept": "boolean"}


def repeated_in_rows(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that occur twice or more in their row; and of all occurrences after the first."""
    key = mix(values + mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = order[1:][same]
    return np.union1d(later, order[:-1][same]), later


def base_counts(part: Slice, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    data, offsets = part.data, part.offsets
    continuation = (data & 0xC0) == 0x80
    chars_before = np.concatenate(([0], np.cumsum(~continuation)))
    word_chars = row_sums(chars_before[words.ends] - chars_before[words.starts], words.first)
    n_symbols = row_sums(SYMBOLS[data], offsets)
    starts = words.gram_starts(3)
    again, _ = repeated_in_rows(gram_hashes(hashes, starts, 3), words.row[starts])
    covered = np.zeros(len(words.row) + 3, bool)
    for k in range(3):
        covered[starts[again] + k] = True
    n_repeat = row_sums(covered[:len(words.row)], words.first)
    return {"n_words": words.counts, "word_chars": word_chars, "n_symbols": n_symbols,
            "n_dup_lines": duplicate_lines(part, words), "n_repeat_words": n_repeat}


def duplicate_lines(part: Slice, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(part.data == 0x0A)
    starts = np.sort(np.concatenate((part.offsets[:-1], breaks + 1)))
    row = np.searchsorted(part.offsets, starts, "right") - 1
    # A break at the end of a row opens an empty line that the offsets would give to the next row; it has no word.
    ends = np.minimum(np.append(breaks, len(part.data))[np.searchsorted(breaks, starts)],
                      part.offsets[np.minimum(row + 1, part.rows)])
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[filled], ends[filled], row[filled]
    if len(starts) > 1:
        new = np.append(True, starts[1:] != starts[:-1])
        starts, ends, row = starts[new], ends[new], row[new]
    _, later = repeated_in_rows(span_hashes(prefix_sums(BYTE_VALUES[part.data]), starts, ends, part.data), row)
    return np.bincount(row[later], minlength=part.rows)


def families(part: Slice, words: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, first place of each row, weight of each row's features) for words, pairs, characters, beginnings."""
    distinct, first = distinct_in_rows(hashes, words.row, part.rows)
    yield (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64), first, 1 / np.sqrt(np.maximum(np.diff(first), 1))
    starts = words.gram_starts(2)
    first = np.searchsorted(words.row[starts], np.arange(part.rows + 1))
    buckets = (gram_hashes(hashes, starts, 2) % np.uint64(PAIR_BUCKETS)).astype(np.int64) + WORD_BUCKETS
    yield buckets, first, DENSE / np.maximum(np.diff(first), 1)
    grams, first = gram_starts_of(part.data, part.offsets, CHAR_SIZE)
    code = np.zeros(len(grams), np.uint32)
    for k in range(CHAR_SIZE):
        code = (code << np.uint32(8)) | part.data[grams + k].astype(np.uint32)
    buckets = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) + WORD_BUCKETS + PAIR_BUCKETS
    yield buckets, first, DENSE / np.maximum(np.diff(first), 1)
    sums = prefix_sums(BYTE_VALUES[LOWER[part.data]])
    for k, size in enumerate(BEGIN_SIZES):
        long = np.flatnonzero(words.ends - words.starts >= size)
        starts = words.starts[long]
        buckets = (span_hashes(sums, starts, starts + size) % np.uint64(BEGIN_BUCKETS)).astype(np.int64)
        yield (buckets + GRAM_END + BEGIN_BUCKETS * k, np.searchsorted(long, words.first),
               BEGIN / np.maximum(words.counts, BEGIN_WORDS))


class Head:
    """One logistic regression with its calibration: probability = sigmoid(slope * (w.x + b) + shift)."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def adam(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    """Minimise by full-batch steps with per-coordinate step sizes."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit_head(columns: list[np.ndarray], values: list[np.ndarray], label: np.ndarray, least: int,
             end: int) -> Head | None:
    """Fit on four fifths of the rows, calibrate on the fifth left out; None if a class has under ten rows.

    `columns` has the distinct features of each row. Only those that are used are laid out for the steps.
    """
    if min((label == 0).sum(), (label == 1).sum()) < 10:
        return None
    n = len(label)
    held = np.arange(n) % 5 == 4
    balance = np.where(label == 1, n / (2 * (label == 1).sum()), n / (2 * (label == 0).sum())) * ~held / n
    rows_with = np.zeros(BUCKETS, np.int32)
    for column in columns:
        rows_with[column] += 1
    seen = rows_with >= least  # what fewer have is learned by heart, says little of others
    seen[end:] = False
    used, number = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)
    sizes = np.array([np.count_nonzero(seen[column]) for column in columns])
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    place, value, at = np.empty(len(row), np.int32), np.empty(len(row), np.float32), 0
    for column, own, size in zip(columns, values, sizes.tolist(), strict=True):
        kept = seen[column]
        place[at:at + size], value[at:at + size] = number[column[kept]], own[kept]
        at += size
    parts = [slice(k, k + BLOCK) for k in range(0, len(row), BLOCK)]  # so that what a step makes on the way is small

    def margins(w: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for part in parts:
            out += np.bincount(row[part], value[part] * w[place[part]], minlength=n)
        return out + w[-1]

    def gradient(w: np.ndarray) -> np.ndarray:
        error = balance * (1 / (1 + np.exp(-np.clip(margins(w), -40, 40))) - label)
        out = np.zeros(len(used))
        for part in parts:
            out += np.bincount(place[part], value[part] * error[row[part]], minlength=len(used))
        return np.append(out, error.sum()) + 3e-5 * w

    w = adam(gradient, len(used) + 1, 80, 0.3)
    margin = margins(w)[held]
    target = label[held]

    def calibration(c: np.ndarray) -> np.ndarray:
        error = 1 / (1 + np.exp(-np.clip((1 + c[0]) * margin + c[1], -40, 40))) - target
        return np.array([(error * margin).mean() + 0.01 * c[0], error.mean() + 0.01 * c[1]])

    c = adam(calibration, 2, 300, 0.03) if 0 < target.sum() < len(target) else np.zeros(2)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w[:-1]
    return Head(weights, float(w[-1]), float(max(1 + c[0], 0.05)), float(c[1]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS) -> dict[str, Head | None]:
    """Both heads from at most `sample_rows` labelled documents, trained in one task; the driver sees their weights."""
    chosen = (labels.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
              .orderBy(F.xxhash64(key), key).limit(sample_rows))
    sample = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key).dropDuplicates([key])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.data, part.offsets)
            found = list(families(part, words, words.hashes(part.data)))
            columns, values = [], []
            for r in range(part.rows):
                own = [np.unique(b[f[r]:f[r + 1]], return_counts=True) for b, f, _ in found]
                columns.append(np.concatenate([b for b, _ in own]).astype(np.int32).tobytes())
                values.append(np.concatenate([n * w[r] if k else np.full(len(n), w[r])
                                              for k, ((_, n), (_, _, w)) in enumerate(zip(own, found, strict=True))])
                              .astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(part.column(key)), "quality": part.batch.column(2), "toxic": part.batch.column(3),
                "columns": pa.array(columns, pa.binary()), "values": pa.array(values, pa.binary())})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, features_schema)
        order = pc.sort_indices(rows["id"]).to_numpy()  # the features are left where they are
        columns = [np.frombuffer(b.as_buffer(), np.int32) for b in rows["columns"]]
        values = [np.frombuffer(b.as_buffer(), np.float32) for b in rows["values"]]
        for name, (least, end) in HEADS.items():
            label = rows[name].to_numpy()
            have = order[np.isfinite(label.astype(float))[order]] if len(label) else np.zeros(0, int)
            if len(have) == 0:
                continue
            head = fit_head([columns[i] for i in have], [values[i] for i in have], (label[have] > 0).astype(float), least,
                            end)
            if head:
                yield pa.RecordBatch.from_pydict({"head": [name], "weights": pa.array([head.weights.tobytes()], pa.binary()),
                                                  "bias": [head.bias], "slope": [head.slope], "shift": [head.shift]})
        del rows, columns, values
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    fields = f"id {kind}, quality double, toxic double, columns binary, values binary"
    made = sample.select(key, "text", "quality", "toxic").mapInArrow(features, fields)
    features_schema = to_arrow_schema(made.schema)
    found = made.repartition(1).mapInArrow(train, "head string, weights binary, bias double, slope double, shift double").collect()
    heads: dict[str, Head | None] = dict.fromkeys(HEADS)
    for r in found:
        heads[r["head"]] = Head(np.frombuffer(r["weights"], np.float32), r["bias"], r["slope"], r["shift"])
    return heads


def judge_with(heads: dict[str, Head | None]):
    """A function from a slice to the columns of FIELDS."""
    def judge(part: Slice) -> dict[str, np.ndarray]:
        words = Words(part.data, part.offsets)
        hashes = words.hashes(part.data)
        out = base_counts(part, words, hashes)
        out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        live = {name: head for name, head in heads.items() if head}
        margins = {name: np.full(part.rows, head.bias) for name, head in live.items()}
        for buckets, first, weight in families(part, words, hashes) if live else ():
            for name, head in live.items():
                margins[name] += weight * row_sums(head.weights[buckets].astype(np.float64), first)
        p = {name: head.probability(margins[name]) for name, head in live.items()}
        out["p_quality"] = p.get("quality", np.ones(part.rows))
        out["p_toxic"] = p.get("toxic", np.zeros(part.rows))
        out["kept"] = ~out["base_failed"] & (out["p_quality"] >= QUALITY_AT_LEAST) & (out["p_toxic"] < TOXIC_BELOW)
        return out

    return judge


def quality_verdicts(docs: DataFrame, heads: dict[str, Head | None], keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and FIELDS for every row."""
    return map_text(docs, text, FIELDS, shared(docs, heads), keep)


def keep_good(docs: DataFrame, heads: dict[str, Head | None], text: str = "text") -> DataFrame:
    """The rows that pass the base rule and both heads, all columns as they came."""
    return map_text(docs, text, {"  kept": "boolean"}, shared(docs, heads), docs.columns, only="  kept")


def shared(docs: DataFrame, heads: dict[str, Head | None]):
    """The judge with its weights (of fixed size, 1.9 million numbers a head) sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(heads)

    def judge(part: Slice) -> dict[str, np.ndarray]:
        out = judge_with(sent.value)(part)
        return out | {"  kept": out["kept"]}

    return judge
