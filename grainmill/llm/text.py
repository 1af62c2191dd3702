"""Text columns as byte buffers: words, hashes and row-wise helpers for Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D. UTF-8 continuation bytes are never in that set, so
bytes and code points agree on word borders. All helpers work on a slice of a batch (`slices`), a few megabytes
of text at a time, so that temporary arrays stay small whatever the length of a batch; a single very long
document is a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
LONG_SPAN = 256
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[k] * base**k for i <= k < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, content: np.ndarray | None = None,
                salt: int = 0) -> np.ndarray:
    """A hash of each span's content and length, the same wherever the content stands.

    Sums modulo 2**64 are the same for some long sequences of two values, whatever the values. With `content`, spans of
    LONG_SPAN values or more get a BLAKE2 hash of their values instead; `salt` names another one.
    """
    down = powers(len(sums))[1]
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    if content is not None:
        long = np.flatnonzero(ends - starts >= LONG_SPAN)
        if len(long):
            content, key = np.ascontiguousarray(content), salt.to_bytes(8, "little")
            out[long] = np.frombuffer(b"".join([
                hashlib.blake2b(content[a:b], digest_size=8, key=key).digest()
                for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), np.uint64)
    return out


class Slice:
    """Rows `begin` to `end` of a batch with their text as one byte buffer."""

    def __init__(self, batch: pa.RecordBatch, begin: int, data: np.ndarray, offsets: np.ndarray):
        self.batch = batch.slice(begin, len(offsets) - 1)
        self.data = data[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.rows = len(offsets) - 1

    def bytes_of(self, row: int) -> memoryview:
        return memoryview(self.data[self.offsets[row]:self.offsets[row + 1]])

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(self.batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is an empty text."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, content = column.buffers()
    kind = np.int64 if wide else np.int32
    if places is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data, offsets


def hold() -> None:
    """Use freed arrays again instead of mapping new pages for each, until `give_back`."""
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 25)  # arrays of up to 32 megabytes come from the heap,
        libc.mallopt(-1, 1 << 27)  # which keeps up to 128 free ones


def give_back() -> None:
    """Return freed memory to the system: workers that wait stay beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The batches' rows, some `limit` bytes of text at a time; after the last, freed memory is given back."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield Slice(batch, begin, data, offsets[begin:end + 1])
            begin = end
    give_back()


class Words:
    """Word borders of a slice: byte `starts` and `ends`, `first` word of each row, `row` of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~SEPARATOR[data]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        if len(data):
            filled = offsets[1:] > offsets[:-1]
            edge = offsets[:-1][filled]
            begins[edge] = inside[edge + 1]
            edge = offsets[1:][filled] - 1
            ends[edge] = inside[edge + 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return span_hashes(prefix_sums(BYTE_VALUES[data]), self.starts, self.ends, data)

    def gram_starts(self, size: int) -> np.ndarray:
        """Indexes of the words at which a run of `size` words of one row begins."""
        if len(self.row) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[:len(self.row) - size + 1] == self.row[size - 1:])


def gram_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words that begin at `starts`."""
    out = hashes[starts]
    for k in range(1, size):
        out = out * np.uint64(_BASE) + hashes[starts + k]
    return mix(out + np.uint64(size))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive `first` positions."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def gram_starts_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte places at which `size` bytes of one row begin, and each row's first place among them."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(first[-1]) + np.repeat(offsets[:-1] - first[:-1], counts), first


def rows_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct_in_rows(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted within it, and each row's first place among them; `row` ascends."""
    values = values.copy()
    first = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(first[:-1], first[1:], strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.searchsorted(row[new], np.arange(rows + 1))


def spark_field(name: str, kind: str) -> str:
    return f"`{name}` {kind}"


def map_text(df: DataFrame, text: str, fields: dict[str, str], judge: Callable[[Slice], dict], keep: list[str],
             only: str | None = None) -> DataFrame:
    """`keep` columns of `df` and the columns `judge` makes of the whole texts; `only` names a boolean to filter by.

    A made column replaces a kept column of the same name.
    """
    kept = [c for c in keep if c not in fields]
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    shown = [f for f in fields if f != only]
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([*(spark_field(c, kinds[c]) for c in kept), *(spark_field(f, fields[f]) for f in shown)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            made = judge(part)
            columns = {c: part.batch.column(part.batch.schema.get_field_index(c)) for c in kept}
            columns |= {f: pa.array(made[f]) for f in shown}
            out = pa.RecordBatch.from_pydict(columns)
            yield out.filter(pa.array(made[only])) if only else out

    return source.mapInArrow(run, schema)
