"""Optimal change points: the segmentation of each series with the least squared error plus penalty.

The best cost of the first t rows is the least, over the last change s, of the best cost of s rows, the squared error
of the rows after s about their mean, and the penalty. A change s stays a candidate only while there is some level
for which no later one does better: over the levels the candidates split the number line into pieces, and one whose
pieces are all taken goes for good. So the search is exact, and few candidates are left at any time.

The work runs along a series, but what it carries is small: the candidates with count, mean and squared error since,
and the changes on which they do not agree yet. A series is therefore fed stretch by stretch. One of more rows than
`grainmill.maxGroupRows` takes several rounds, each a task of that many rows for each series; all series run abreast.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import MAX_GROUP_ROWS, cut_lineage, setting
from .ordered import number_rows

PENALTY, MIN_SIZE, JUMP = 10.0, 2, 5   # fixed values: defaults of the usual solver
SETTLE_EVERY = 4096


class Segmenter:
    """Penalised least-squares segmentation of one series, fed in order, a stretch at a time."""

    def __init__(self, penalty: float = PENALTY, min_size: int = MIN_SIZE, jump: int = JUMP):
        if penalty < 0 or min_size < 1 or jump < 1:
            raise ValueError("penalty must not be negative, min_size and jump at least 1")
        self.penalty, self.min_size, self.jump = penalty, min_size, jump
        self.size, self.root, self.evaluated = 0, 0, 0
        self.rest = np.zeros(0)
        # Candidates: place, best cost before it (less that of the last place judged), and what lies after it.
        self.at, self.cost = np.zeros(1, np.int64), np.zeros(1)
        self.n, self.mean, self.error = np.zeros(1), np.zeros(1), np.zeros(1)
        # Pieces of the number line of levels, and the candidate that is best on each.
        self.low, self.high, self.owner = np.array([-np.inf]), np.array([np.inf]), np.zeros(1, np.int64)
        self.pending: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.before: dict[int, tuple[int, float, float]] = {}  # place: (last change, mean and error since)
        self.settled: list[tuple[int, int, float, float]] = []

    def feed(self, values: np.ndarray) -> None:
        values = np.concatenate((self.rest, np.asarray(values, float)))
        whole = len(values) // self.jump * self.jump
        blocks, self.rest = values[:whole].reshape(-1, self.jump), values[whole:]
        means = blocks.mean(axis=1)
        errors = ((blocks - means[:, None]) ** 2).sum(axis=1)
        for mean, error in zip(means.tolist(), errors.tolist(), strict=True):
            self._extend(self.jump, mean, error)
            if self.size >= self.min_size:
                self._judge()
                if len(self.before) >= SETTLE_EVERY and self.evaluated % SETTLE_EVERY == 0:
                    self._settle()

    def finish(self) -> list[tuple[int, int, float, float]]:
        """(first row, last row, mean, squared error) of the segments not yet taken; rows count from 1."""
        if len(self.rest):
            mean = float(self.rest.mean())
            self._extend(len(self.rest), mean, float(((self.rest - mean) ** 2).sum()))
            self.rest = np.zeros(0)
        if self.size > self.root and self.size not in self.before:
            if self.at[0] + self.min_size <= self.size:
                self._judge()
            else:  # fewer rows than a segment needs
                self.before[self.size] = (int(self.at[0]), float(self.mean[0]), float(self.error[0]))
        tail, place = [], self.size
        while place > self.root:
            start, mean, error = self.before[place]
            tail.append((start + 1, place, mean, error))
            place = start
        return self.take() + tail[::-1]

    def take(self) -> list[tuple[int, int, float, float]]:
        """The segments that are certain whatever follows, each given once."""
        out, self.settled = self.settled, []
        return out

    def _extend(self, count: int, mean: float, error: float) -> None:
        self.size += count
        total = self.n + count
        shift = mean - self.mean
        self.error += error + shift * shift * self.n * count / total
        self.mean += shift * count / total
        self.n = total

    def _judge(self) -> None:
        self.evaluated += 1
        while self.pending and self.pending[0][0] + self.min_size <= self.size:
            self._admit(*self.pending.pop(0))
        usable = int(np.searchsorted(self.at, self.size - self.min_size, "right"))
        total = self.cost[:usable] + self.error[:usable]
        best = int(np.argmin(total))
        self.before[self.size] = (int(self.at[best]), float(self.mean[best]), float(self.error[best]))
        # Costs are kept relative to the newest one, so that errors settled long ago do not drown small gains.
        self.cost = self.cost - (total[best] + self.penalty)
        width = -(self.cost + self.error) / self.n
        reach = np.sqrt(np.maximum(width, 0.0))
        empty = width < 0
        self.pending.append((self.size, self.at, np.where(empty, np.inf, self.mean - reach),
                             np.where(empty, -np.inf, self.mean + reach)))
        for name, value in (("at", self.size), ("cost", 0.0), ("n", 0.0), ("mean", 0.0), ("error", 0.0)):
            setattr(self, name, np.append(getattr(self, name), value))

    def _admit(self, place: int, known: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Give a candidate the levels at which it beats the older ones, which keep theirs from `low` to `high`."""
        k = np.searchsorted(known, self.owner)
        a, b = np.maximum(self.low, low[k]), np.minimum(self.high, high[k])
        none = ~(a < b)
        a, b = np.where(none, self.high, a), np.where(none, self.high, b)
        lows = np.stack((self.low, a, b), axis=1).ravel()
        highs = np.stack((a, b, self.high), axis=1).ravel()
        owners = np.stack((np.full(len(k), place), self.owner, np.full(len(k), place)), axis=1).ravel()
        keep = lows < highs
        lows, highs, owners = lows[keep], highs[keep], owners[keep]
        new = np.append(True, owners[1:] != owners[:-1])
        self.low, self.owner = lows[new], owners[new]
        self.high = np.append(self.low[1:], np.inf)
        live = np.isin(self.at, self.owner) | (self.at > place)
        for name in ("at", "cost", "n", "mean", "error"):
            setattr(self, name, getattr(self, name)[live])

    def _settle(self) -> None:
        """Hand over the segments that all candidates have in common, and forget changes that none has."""
        shared: set[int] | None = None
        every: set[int] = set()
        for place in self.at.tolist():
            chain = set()
            while place > self.root and place not in chain:
                chain.add(place)
                place = self.before[place][0]
            every |= chain
            shared = chain if shared is None else shared & chain
        for place in sorted(shared or ()):
            start, mean, error = self.before[place]
            self.settled.append((start + 1, place, mean, error))
            self.root = place
        self.before = {p: self.before[p] for p in every if p > self.root}

    def dump(self) -> str:
        self._settle()
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}
        plain["pending"] = [(p, *(x.tolist() for x in rest)) for p, *rest in self.pending]
        plain["before"] = list(self.before.items())
        plain["settled"] = []
        return json.dumps(plain)

    @classmethod
    def load(cls, text: str) -> "Segmenter":
        out = cls()
        for name, value in json.loads(text).items():
            kind = getattr(out, name)
            setattr(out, name, np.array(value, kind.dtype) if isinstance(kind, np.ndarray) else value)
        out.pending = [(p, np.array(k, np.int64), np.array(a, float), np.array(b, float)) for p, k, a, b in out.pending]
        out.before = {p: tuple(v) for p, v in out.before}
        return out


def optimal_segments(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str], penalty: float = PENALTY,
                     min_size: int = MIN_SIZE, jump: int = JUMP) -> DataFrame:
    """(keys, first, last, level, error) of every segment: rows `first` to `last` of the series, counted from 1.

    Changes lie on multiples of `jump`, segments have `min_size` rows or more; 1 and 1 allow every change. NULL and NaN
    values are left out before rows are counted. Of equally good segmentations the one with the longer last segment.
    """
    limit = setting(df.sparkSession, MAX_GROUP_ROWS)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    numbered = number_rows(clean, keys, order_by, "__place")
    names = [f"__k{i}" for i in range(max(1, len(keys)))]
    rows = numbered.select(*[F.col(k).alias(n) for k, n in zip(keys or [None], names) if k is not None],
                           *([] if keys else [F.lit(0).alias(names[0])]), "__place", F.col(value).cast("double").alias("__v"))
    last = rows.agg(F.max("__place")).first()[0] or 0
    rounds = max(1, -(-last // limit))
    if rounds > 1:
        rows = cut_lineage(rows)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names],
                        "first bigint, last bigint, level double, error double, state string"])

    def advance(table: pa.Table, state: str | None, end: bool) -> pa.Table:
        work = Segmenter.load(state) if state else Segmenter(penalty, min_size, jump)
        work.feed(table.sort_by("__place")["__v"].to_numpy())
        kept = None if end else work.dump()
        found = work.finish() if end else work.take()
        cells = [*found, *([(None, None, None, None)] if kept else [])]
        columns = {c: pa.array([r[i] for r in cells], t) for i, (c, t) in enumerate(
            (("first", pa.int64()), ("last", pa.int64()), ("level", pa.float64()), ("error", pa.float64())))}
        columns["state"] = pa.array([None] * len(found) + ([kept] if kept else []), pa.string())
        return columns, len(cells)

    def with_keys(source: pa.Table, made: tuple[dict, int]) -> pa.Table:
        columns, n = made
        own = {k: source[k].combine_chunks().take(pa.array([0] * n, pa.int64())) for k in names}
        return pa.table({**own, **columns})

    def alone(table: pa.Table) -> pa.Table:
        return with_keys(table, advance(table, None, True))

    def carried(end: bool):
        def step(table: pa.Table, states: pa.Table) -> pa.Table:
            state = states["state"][0].as_py() if states.num_rows else None
            return with_keys(table if table.num_rows else states, advance(table, state, end))
        return step

    if rounds == 1:
        out = rows.groupBy(*names).applyInArrow(alone, schema)
    else:
        out = None
        states = rows.limit(0).select(*names, F.lit("").alias("state"))
        for k in range(rounds):
            stretch = rows.filter(F.floor((F.col("__place") - 1) / limit) == k)
            made = stretch.groupBy(*names).cogroup(states.groupBy(*names)).applyInArrow(carried(k == rounds - 1), schema)
            made = cut_lineage(made)
            states = made.filter("state is not null").select(*names, "state")
            out = made if out is None else out.unionByName(made)
    return out.filter("first is not null").select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], "first", "last", "level", "error")


def optimal_changepoints(df: DataFrame, value: str, keys: Sequence[str], order_by: Sequence[str],
                         penalty: float = PENALTY, min_size: int = MIN_SIZE, jump: int = JUMP) -> DataFrame:
    """(keys, position, level): the rows at which a new level begins, counted from 1."""
    found = optimal_segments(df, value, keys, order_by, penalty, min_size, jump)
    return found.filter(F.col("first") > 1).select(*keys, F.col("first").alias("position"), "level")
