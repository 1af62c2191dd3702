"""Connected components by alternating large and small stars: every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.scratch import discard, store


def _point(edges: DataFrame) -> DataFrame:
    """(u, v, least) with the smallest v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_point(both).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct())


def small_star(edges: DataFrame) -> DataFrame:
    pointed = _point(edges)
    return (pointed.select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u != v")
            .union(pointed.select("u", F.col("least").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each linked id and the smallest id it reaches, itself apart. `edges` has u > v."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = store(edges.distinct())
    before = state(edges)
    while before[0]:
        further = store(small_star(large_star(edges)))
        discard(edges)
        edges = further
        now = state(edges)
        if now == before:
            break
        before = now
    return edges
