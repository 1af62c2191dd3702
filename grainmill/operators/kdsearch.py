"""Exact nearest neighbours in any number of columns, with gaps, by one k-d partition.

A tree is grown from a bounded sample of the points: a node whose points lack some column is split by who has it, any
other one at the median of its widest column. All points are dealt to its leaves; crowded leaves are sampled again and
split further. Of every leaf its box, its size and which columns its points always or ever have are known; that table
has MAX_LEAVES rows at most and goes to all tasks.

A query first visits the nearest leaves that hold enough points. The distance found there bounds the rest: only leaves
whose box may be as near are visited then. Distances count the columns both rows have, scaled up for those they lack,
and the bounds of a leaf follow the same rule, so rows with any pattern of gaps are searched together. The number of jobs
depends on neither rows, columns nor patterns. Inside a leaf, queries and points meet as matrices, some at a time; a leaf
with many visitors is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

LEAF_ROWS, MAX_LEAVES = 1024, 1 << 14
SAMPLE_ROWS = 200_000
CROWDED = 4              # times the wanted size
VISITORS = 50_000        # visits of one leaf that a task takes
CELLS = 1 << 21


class Tree:
    """Splits by value (`limit` is a number) or by presence (`limit` is NaN); leaves are numbered from 0."""

    def __init__(self) -> None:
        self.column, self.limit, self.left, self.right = [-1], [np.nan], [-1], [-1]
        self.leaf = [0]
        self.leaves = 1

    def split(self, leaf: int, sample: np.ndarray, wanted: float) -> None:
        """Grow the node of `leaf` until its parts hold no more than `wanted` rows of the sample, or equal ones."""
        work = [(self.leaf.index(leaf), sample)]
        while work:
            node, rows = work.pop()
            found = choose_split(rows) if len(rows) > wanted and self.leaves < MAX_LEAVES else None
            if found is None:
                continue
            column, limit = found
            first = goes_left(rows[:, column], limit)
            self.column[node], self.limit[node] = column, limit
            self.left[node], self.right[node] = len(self.column), len(self.column) + 1
            for number in (self.leaf[node], self.leaves):
                for name, value in (("column", -1), ("limit", np.nan), ("left", -1), ("right", -1), ("leaf", number)):
                    getattr(self, name).append(value)
            self.leaf[node] = -1
            self.leaves += 1
            work += [(self.left[node], rows[first]), (self.right[node], rows[~first])]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        column, limit, left, right, leaf = (np.array(v) for v in (self.column, self.limit, self.left, self.right, self.leaf))
        node = np.zeros(len(x), np.int64)
        moving = np.flatnonzero(column[node] >= 0)
        while len(moving):
            at = node[moving]
            value, bound = x[moving, column[at]], limit[at]
            first = np.where(np.isnan(bound), np.isnan(value), value <= bound)
            node[moving] = np.where(first, left[at], right[at])
            moving = moving[column[node[moving]] >= 0]
        return leaf[node]


def goes_left(values: np.ndarray, limit: float) -> np.ndarray:
    return np.isnan(values) if np.isnan(limit) else values <= limit


def choose_split(rows: np.ndarray) -> tuple[int, float] | None:
    there = ~np.isnan(rows)
    some = np.minimum(there.sum(axis=0), (~there).sum(axis=0))
    if some.max(initial=0) > 0:
        return int(np.argmax(some)), np.nan
    full = np.flatnonzero(there.all(axis=0))
    if not len(full):
        return None
    spread = rows[:, full].max(axis=0) - rows[:, full].min(axis=0)
    best = int(np.argmax(spread))
    if not spread[best] > 0:
        return None
    values = rows[:, full[best]]
    middle = np.median(values)
    return int(full[best]), float(middle if middle < values.max() else values[values < values.max()].max())


class Leaves:
    """What is known of the leaves: boxes, numbers of points (by weight) that have each column, and in all."""

    def __init__(self, number: np.ndarray, low: np.ndarray, high: np.ndarray, have: np.ndarray, size: np.ndarray, rows: np.ndarray):
        self.number, self.size = number, size
        self.low, self.high = low, high
        self.always, self.ever = rows[:, None] == have, have > 0
        self.have = have

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """(queries, leaves): least squared distance that a point of the leaf may have; infinite without a common column."""
        there = ~np.isnan(x)
        total = np.zeros((len(x), len(self.number)))
        with np.errstate(invalid="ignore"):
            for j in range(x.shape[1]):
                gap = np.maximum(np.maximum(self.low[None, :, j] - x[:, j, None], x[:, j, None] - self.high[None, :, j]), 0.0)
                total += np.where(there[:, j, None] & self.always[None, :, j], gap * gap, 0.0)
            common = there.astype(float) @ self.ever.T.astype(float)
            return np.where(common > 0, total * (x.shape[1] / np.maximum(common, 1.0)), np.inf)

    def first_visits(self, near: np.ndarray, x: np.ndarray, k: int, fill: bool) -> np.ndarray:
        """(queries, leaves): the nearest leaves that together have k points for each gap to fill (or k points)."""
        order = np.argsort(near, axis=1, kind="stable")
        reachable = np.isfinite(np.take_along_axis(near, order, axis=1))
        out = np.zeros(near.shape, bool)
        sizes = [self.have[:, j] for j in range(x.shape[1])] if fill else [self.size]
        asks = np.isnan(x) if fill else np.ones((len(x), 1), bool)
        for j, size in enumerate(sizes):
            held = np.where(reachable, size[order], 0)
            wanted = (np.cumsum(held, axis=1) - held < k) & (held > 0) & asks[:, j, None]
            np.put_along_axis(out, order, wanted | np.take_along_axis(out, order, axis=1), axis=1)
        return out


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _partition(points: DataFrame, dims: int) -> tuple[DataFrame, Tree]:
    """(rank, x, w, leaf) and the tree that deals the points to leaves."""
    tree, total = Tree(), points.count()
    wanted = max(LEAF_ROWS, -(-total // MAX_LEAVES))

    def sampled(rows: DataFrame, n: int) -> DataFrame:
        every = max(1, n // SAMPLE_ROWS)
        return rows.filter(F.pmod(F.xxhash64("rank"), F.lit(every)) == 0) if every > 1 else rows

    if total > wanted:
        table = sampled(points, total).select("x").toArrow()
        tree.split(0, _matrix(table["x"], dims), wanted * table.num_rows / total)
    while True:
        sent = points.sparkSession.sparkContext.broadcast(tree)

        def deal(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = sent.value.route(_matrix(batch.column(1), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        dealt = cut_lineage(points.select("rank", "x", "w").mapInArrow(deal, "rank bigint, x array<double>, w bigint, leaf bigint"))
        sizes = {r.leaf: r.n for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        crowded = {leaf: n for leaf, n in sizes.items() if n > CROWDED * wanted}
        before = tree.leaves
        if crowded and before < MAX_LEAVES:
            among = dealt.join(F.broadcast(dealt.sparkSession.createDataFrame([(x,) for x in crowded], "leaf bigint")), "leaf")
            table = sampled(among, sum(crowded.values())).select("leaf", "x").toArrow()
            leaf, x = table["leaf"].to_numpy(), _matrix(table["x"], dims)
            for number, n in sorted(crowded.items()):
                own = x[leaf == number]
                tree.split(number, own, max(1.0, wanted * len(own) / n))
        if tree.leaves == before:
            return dealt, tree


def _leaf_table(dealt: DataFrame, dims: int) -> Leaves:
    value = [F.get("x", F.lit(j)) for j in range(dims)]
    there = [F.when(~F.isnan(v), v) for v in value]
    rows = dealt.groupBy("leaf").agg(
        F.array(*[F.coalesce(F.min(v), F.lit(0.0)) for v in there]).alias("low"), F.array(*[F.coalesce(F.max(v), F.lit(0.0)) for v in there]).alias("high"),
        F.array(*[F.count(v).cast("double") for v in there]).alias("have"), F.sum("w").alias("size"), F.count(F.lit(1)).alias("rows")).toArrow()
    return Leaves(rows["leaf"].to_numpy(), *(_matrix(rows[c], dims) for c in ("low", "high", "have")),
                  rows["size"].to_numpy(), rows["rows"].to_numpy())


def _visit(visits: DataFrame, dealt: DataFrame, dims: int, k: int, fill: bool) -> DataFrame:
    """(qid, c, rank, dist, w, v): the best points of each visited leaf; c is the gap they fill, or -1."""
    counts = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("shares")).filter("shares > 1")
    counts = F.broadcast(cut_lineage(counts))  # one row a leaf at most
    asked = visits.join(counts, "leaf", "left").select(
        "leaf", F.pmod(F.xxhash64("qid"), F.coalesce("shares", F.lit(1))).alias("share"), "qid", "x")
    held = dealt.join(counts, "leaf", "left").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("shares", F.lit(1)) - 1)).alias("share"), "rank", "x", "w")

    def meet(queries: pa.Table, points: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        if queries.num_rows and points.num_rows:
            points = points.sort_by("rank")  # equal distances go to the smaller rank
            p, q = _matrix(points["x"], dims), _matrix(queries["x"], dims)
            rank, w, qid = points["rank"].to_numpy(), points["w"].to_numpy(), queries["qid"].to_numpy()
            p_there = ~np.isnan(p)
            step = max(1, CELLS // len(p))
            for a in range(0, len(q), step):
                some = q[a:a + step]
                there = ~np.isnan(some)
                total = np.zeros((len(some), len(p)))
                for j in range(dims):
                    gap = some[:, j, None] - p[None, :, j]
                    total += np.where(there[:, j, None] & p_there[None, :, j], gap * gap, 0.0)
                common = there.astype(float) @ p_there.T.astype(float)
                distance = np.where(common > 0, np.sqrt(total * (dims / np.maximum(common, 1.0))), np.inf)
                for c in range(dims) if fill else (-1,):
                    rows = np.flatnonzero(~there[:, c]) if fill else np.arange(len(some))
                    columns = np.flatnonzero(p_there[:, c]) if fill else np.arange(len(p))
                    if not len(rows) or not len(columns):
                        continue
                    d = distance[np.ix_(rows, columns)]
                    last = np.partition(d, min(k, len(columns)) - 1, axis=1)[:, min(k, len(columns)) - 1]
                    i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
                    near = d[i, j]
                    order = np.lexsort((j, near, i))
                    i, j, near = i[order], j[order], near[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, near = i[place < k], j[place < k], near[place < k]
                    chosen = columns[j]
                    for part, value in zip(out, (qid[a + rows[i]], np.full(len(i), c, np.int32), rank[chosen], near, w[chosen],
                                                 p[chosen, c] if fill else np.zeros(len(i)))):
                        part.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(np.concatenate(part) if part else [], t)
                         for n, part, t in zip(("qid", "c", "rank", "dist", "w", "v"), out, kinds)})

    return asked.groupBy("leaf", "share").cogroup(held.groupBy("leaf", "share")).applyInArrow(
        meet, "qid bigint, c int, rank bigint, dist double, w bigint, v double")


def kd_search(queries: DataFrame, points: DataFrame, dims: int, k: int, fill: bool = False) -> DataFrame:
    """(qid, c, rank, dist, w, v, before): the nearest points of each query, until their weights reach `k`.

    `queries` has (qid, x), `points` has (rank, x, w) with x an array of `dims` numbers, NaN for a gap. With `fill` a
    search is made for each gap c of a query among the points that have it, and v is their value; else c is -1.
    `before` is the weight of the nearer points. Equal distances go to the smaller rank.
    """
    dealt, tree = _partition(points, dims)
    leaves = _leaf_table(dealt, dims)
    sent = dealt.sparkSession.sparkContext.broadcast(leaves)
    queries = cut_lineage(queries.select("qid", "x"))
    schema = "leaf bigint, qid bigint, x array<double>"

    def visits(batches: Iterator[pa.RecordBatch], bounded: bool) -> Iterator[pa.RecordBatch]:
        held = sent.value
        step = max(1, CELLS // max(len(held.number), 1))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                x = _matrix(some.column(1), dims)
                near = held.nearest(x)
                chosen = held.first_visits(near, x, k, fill)
                if bounded:
                    bound = _matrix(some.column(2), dims if fill else 1)  # infinite where not enough was found
                    limit = bound * (1 + 1e-9)
                    further = np.zeros(near.shape, bool)
                    for j in range(limit.shape[1]):
                        asks = np.isnan(x[:, j]) if fill else np.ones(len(x), bool)
                        has = held.have[:, j] > 0 if fill else held.size > 0
                        further |= asks[:, None] & has[None, :] & np.isfinite(near) & (np.sqrt(near) <= limit[:, j, None])
                    chosen = further & ~chosen
                i, j = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.number[j]), some.column(0).take(pa.array(i)), some.column(1).take(pa.array(i))], ["leaf", "qid", "x"])

    found = _visit(queries.mapInArrow(lambda b: visits(b, False), schema), dealt, dims, k, fill)
    order = Window.partitionBy("qid", "c").orderBy("dist", "rank")
    so_far = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    if tree.leaves > 1:
        found = cut_lineage(found)
        reached = found.withColumn("sum", so_far).filter(F.col("sum") >= k).groupBy("qid", "c").agg(F.min("dist").alias("bound"))
        every = reached.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("c", "bound"))).alias("bounds"))
        places = F.sequence(F.lit(0), F.lit(dims - 1)) if fill else F.array(F.lit(-1))
        limits = F.transform(places, lambda c: F.coalesce(F.try_element_at("bounds", c), F.lit(float("inf"))))
        bounded = queries.join(every, "qid", "left").select("qid", "x", F.when(F.col("bounds").isNull(), F.transform(
            places, lambda c: F.lit(float("inf")))).otherwise(limits).alias("limits"))
        more = cut_lineage(bounded.mapInArrow(lambda b: visits(b, True), schema))
        found = found.unionByName(_visit(more, dealt, dims, k, fill))
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).filter(F.col("before") < k)
