"""URL filter: rules first, and a character language-model ratio for what no rule fits.

Urls that a rule allows or blocks train two smoothed variable-order Markov models of their characters (orders 0 to
`ORDER`, each order backed by the shorter one as in Witten-Bell smoothing). Counts cover every url that a rule
fits; they are kept in `BUCKETS` hashed cells an order, so the model has the same size for any input. Four fifths of
the urls (by a hash of the url) give the counts; the last fifth gives the threshold on the log-likelihood difference
a character, between the two groups of calibration urls where fewest of either, by share, fall on the wrong side.

A null url, or one without `://`, has an empty host and path and fits no rule. Where a group has no url to learn from,
the verdict of the method is allow. Repeated urls are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.text import Slice, map_text, mix, row_sums, rows_of, slices

ORDER, BUCKETS, BINS, LIMIT = 5, 1 << 16, 4001, 4.0
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules: tuple = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and ruled (allow, block or null); the longest fitting rule wins, the first of equals."""
    parts = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = (((F.col("host") == name) | F.col("host").endswith(f".{name}"))
                & F.col("path").startswith(f"/{rest}"))
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return parts.withColumn("rule", rule).withColumn("ruled", ruled)


def contexts(part: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the cells of (context, next byte) and of the context, one entry for each byte of the slice."""
    row = rows_of(part.offsets)
    place = np.arange(len(part.data)) - part.offsets[:-1][row]
    out, context = [], np.zeros(len(part.data), np.uint64)
    for order in range(ORDER + 1):
        if order:
            before = np.zeros(len(part.data), np.uint64)
            inside = np.flatnonzero(place >= order)
            before[inside] = part.data[inside - order].astype(np.uint64) + np.uint64(1)
            context = mix(context * np.uint64(257) + before + np.uint64(order))
        both = mix(context ^ (part.data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        out.append(((both % np.uint64(BUCKETS)).astype(np.int64), (context % np.uint64(BUCKETS)).astype(np.int64)))
    return out


def counts(pages: DataFrame, url: str) -> np.ndarray:
    """[group, order, kind (pair, context, kinds of next byte), cell]: summed by Spark, of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, ORDER + 1, 2, BUCKETS), np.int64)
        for part in slices(batches, "url"):
            group = part.column("block").astype(bool)[rows_of(part.offsets)]
            for order, cells in enumerate(contexts(part)):
                for kind, cell in enumerate(cells):
                    for g in (0, 1):
                        held[g, order, kind] += np.bincount(cell[group == g], minlength=BUCKETS)
        flat = held.ravel()
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used), "n": pa.array(flat[used])})

    rows = (pages.select(F.col(url).alias("url"), (F.col("ruled") == "block").alias("block"))
            .mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(2 * (ORDER + 1) * 2 * BUCKETS)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(2, ORDER + 1, 2, BUCKETS)


def differences(part: Slice, table: np.ndarray) -> np.ndarray:
    """Mean over a url's bytes of log p(accepted model) - log p(rejected model)."""
    p = np.full((2, len(part.data)), 1 / 256)
    for order, (pair, context) in enumerate(contexts(part)):
        for g in (0, 1):
            seen = table[g, order, 1][context]
            kinds = np.minimum(seen, 4 + seen / 8)  # weight of the shorter context
            p[g] = np.where(seen > 0, (table[g, order, 0][pair] + kinds * p[g]) / np.maximum(seen + kinds, 1), p[g])
    length = np.diff(part.offsets)
    return row_sums(np.log(p[0]) - np.log(p[1]), part.offsets) / np.maximum(length, 1)


def threshold(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """Edge of histogram bins that minimises the sum of the shares on the wrong side, nearest to zero of equals."""
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)
    below = np.concatenate(([0], np.cumsum(accepted))) / max(accepted.sum(), 1)
    above = 1 - np.concatenate(([0], np.cumsum(rejected))) / max(rejected.sum(), 1)
    wrong = np.round(below + above, 9)
    best = np.flatnonzero(wrong == wrong.min())
    return float((edges[best[0]] + edges[best[-1]]) / 2)  # the middle of the gap between the groups


def fit(ruled: DataFrame, url: str = "url") -> tuple[np.ndarray, float] | None:
    """The counts and the threshold; None if a group has no url to learn or to calibrate from."""
    known = ruled.filter(F.col("ruled").isNotNull() & F.col(url).isNotNull())
    held = F.pmod(F.xxhash64(url), F.lit(5)) == 4
    table = counts(known.filter(~held), url)
    if not (table[:, 0, 1].sum(axis=1) > 0).all():
        return None
    sent = ruled.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BINS), np.int64)
        for part in slices(batches, "url"):
            bins = np.clip((differences(part, sent.value) + LIMIT) / (2 * LIMIT) * BINS, 0, BINS - 1).astype(int)
            for g in (0, 1):
                held[g] += np.bincount(bins[part.column("block").astype(bool) == g], minlength=BINS)
        flat = held.ravel()
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(used), "n": pa.array(flat[used])})

    rows = (known.filter(held).select(F.col(url).alias("url"), (F.col("ruled") == "block").alias("block"))
            .mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow())
    bins = np.zeros(2 * BINS)
    bins[rows["bin"].to_numpy()] = rows["n"].to_numpy()
    accepted, rejected = bins.reshape(2, BINS)
    if not (accepted.sum() and rejected.sum()):
        return None
    return table, threshold(accepted, rejected)


def url_verdicts(pages: DataFrame, keep: list[str], rules: tuple = RULES, url: str = "url") -> DataFrame:
    """`keep` columns, host, path, rule, score (log-likelihood difference a byte), threshold, verdict."""
    ruled = with_rules(pages.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, url])]), rules, url)
    model = fit(ruled, url)
    if model is None:
        return ruled.select(*keep, "host", "path", "rule", F.lit(None).cast("double").alias("score"),
                            F.lit(None).cast("double").alias("threshold"),
                            F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    table, limit = model
    sent = pages.sparkSession.sparkContext.broadcast(table)

    def judge(part: Slice) -> dict[str, np.ndarray]:
        return {"score": differences(part, sent.value)}

    kept = [*dict.fromkeys([*keep, "host", "path", "rule", "ruled"])]
    scored = map_text(ruled, url, {"score": "double"}, judge, kept)
    own = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return scored.select(*keep, "host", "path", "rule", "score", F.lit(limit).alias("threshold"),
                         F.coalesce("ruled", own).alias("verdict"))
