"""Benchmark decontamination with DataFrame functions only: SimHash windows, Hamming blocks, exact verification.

A document leaks an item if some window of the item's length in words (the whole document if it is shorter) has a
weighted Jaccard similarity of `percent` / 100 or more with it: shingles of five words, weighted by how often they
occur. Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.

1. A window without a common shingle has similarity 0, and moving a window right until it begins with a common
   shingle loses none. So windows are cut at the places of shingles that the benchmark has (one join), no others.
2. Each window and each item gets a 64-bit SimHash; the fingerprint is cut into RADIUS + 1 blocks, and a window stays
   if one block equals the item's: all fingerprints within RADIUS bits do. At similarity 0.8 the distance is 9.7 bits
   on average with a deviation of 2.9, so RADIUS lies more than five deviations above it.
3. What is within RADIUS bits is verified on the shingles and their counts.

Null and empty texts and items leak nothing. Items of fewer than five words use one shingle of all their words.
Repeated rows give one pair. The benchmark's shingles are broadcast after their number is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.scratch import freeze

SHINGLE, PERCENT, RADIUS = 5, 80, 26
BROADCAST_SHINGLES = 500_000  # two numbers each: 8 MB
BROADCAST_DOCS = 1_000_000
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r"
_TO = "abcdefghijklmnopqrstuvwxyz     "
BITS = 64


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for a null."""
    found = F.array_remove(F.split(F.translate(text, _FROM, _TO), " "), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def shingles(tokens: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, in order."""
    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(tokens, i + k) for k in range(size)])

    return F.when(F.size(tokens) >= size, F.transform(F.sequence(F.lit(0), F.size(tokens) - size), one)) \
        .otherwise(F.array().cast("array<bigint>"))


def simhash(keys: list[str]) -> list[Column]:
    """Aggregates for a SimHash of the column `hash`: two bit counters in each sum, 32 bits apart."""
    return [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"s{k}")
            for k in range(BITS // 2)]


def fingerprint() -> Column:
    """The 64 bits for which most of the shingles counted by `simhash` have a one; `total` is their number."""
    out = F.lit(0).cast("long")
    for k in range(BITS // 2):
        for place, count in ((k, F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF))),
                             (k + 32, F.shiftrightunsigned(f"s{k}", 32))):
            out = out.bitwiseOR(F.shiftleft((count * 2 > F.col("total")).cast("long"), place))
    return out


def blocks(bits: Column, radius: int) -> Column:
    """The fingerprint cut into radius + 1 pieces, each with its number: two within the radius share one at least."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(k << BITS // 2)
                     for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def benchmark_index(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, length, size, hash, count): the shingles of each item, rows with the same id being one item."""
    rows = (benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("tokens"))
            .filter(F.size("tokens") > 0).groupBy("item").agg(F.max("tokens").alias("tokens")))
    size = F.least(F.size("tokens"), F.lit(SHINGLE))
    found = F.coalesce(*[F.when(size == k, shingles(F.col("tokens"), k)) for k in range(1, SHINGLE + 1)])
    return (rows.select("item", F.size("tokens").alias("length"), size.alias("size"), F.explode(found).alias("hash"))
            .groupBy("item", "length", "size", "hash").agg(F.count(F.lit(1)).alias("count")))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS, key: str = "doc_id",
          text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, shared, total, similarity): each leaked item with its best window, the last of equals.

    shared and total are the summed smaller and larger counts of the shingles of the window and the item.
    """
    index = freeze(benchmark_index(benchmark, item, item_text))
    sizes = sorted(r.size for r in index.select("size").distinct().collect())  # 1 to SHINGLE
    known = index.select("size", "hash").distinct()
    few = known.count() <= BROADCAST_SHINGLES
    texts = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), words(F.col(text)).alias("tokens"))
    hits = None
    for size in sizes:
        found = texts.select("doc", F.size("tokens").alias("n"),
                             F.posexplode(shingles(F.col("tokens"), size)).alias("place", "hash"))
        own = known.filter(F.col("size") == size).select("hash")
        found = found.join(F.broadcast(own) if few else own, "hash", "left_semi").withColumn("size", F.lit(size))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = texts.select("doc", F.lit(0).alias("n"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("hash"),
                            F.lit(0).alias("size")).limit(0)
    hits = freeze(hits)

    owners = index.select("size", "hash", "item", "length")
    starts = F.greatest(F.lit(0), F.least("place", F.col("n") - F.col("length")))
    windows = (hits.join(F.broadcast(owners) if few else owners, ["size", "hash"])
               .select("doc", "item", "length", "size", starts.alias("start")).distinct())
    wanted = hits.select("doc").distinct()
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_DOCS else wanted
    cut = (texts.join(near, "doc", "left_semi").dropDuplicates(["doc"])
           .join(windows, "doc")
           .select("doc", "item", "start", "size", F.expr("slice(tokens, start + 1, length)").alias("tokens")))
    grams = F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("tokens"), k)) for k in sizes or [SHINGLE]])
    grams = cut.select("doc", "item", "start", F.explode(grams).alias("hash"))
    group = ["doc", "item", "start"]
    printed = (grams.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *simhash(group))
               .select(*group, "total", fingerprint().alias("print")))
    prints = (index.withColumn("hash", F.explode(F.array_repeat("hash", F.col("count").cast("int"))))
              .groupBy("item").agg(F.count(F.lit(1)).alias("total"), *simhash(["item"]))
              .select("item", F.col("total").alias("item_total"), fingerprint().alias("item_print")))
    blocked = prints.select("item", "item_total", "item_print",
                            F.explode(blocks(F.col("item_print"), radius)).alias("block"))
    near_windows = (printed.select("*", F.explode(blocks(F.col("print"), radius)).alias("block"))
                    .join(F.broadcast(blocked) if few else blocked, ["item", "block"])
                    .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
                    .groupBy(*group).agg(F.first("total").alias("total"), F.first("item_total").alias("item_total")))
    counted = grams.groupBy(*group, "hash").agg(F.count(F.lit(1)).alias("seen"))
    counts = index.select("item", "hash", "count")
    shared = (counted.join(F.broadcast(counts) if few else counts, ["item", "hash"])
              .groupBy(*group).agg(F.sum(F.least("seen", "count")).alias("shared")))
    verified = (near_windows.join(shared, group)
                .withColumn("all", F.col("total") + F.col("item_total") - F.col("shared"))
                .filter(100 * F.col("shared") >= percent * F.col("all")))
    best = verified.groupBy("doc", "item").agg(F.min(F.struct(
        (-F.col("shared") / F.col("all")).alias("order"), (-F.col("start")).alias("back"), "shared", "all")).alias("best"))
    return best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"),
                       (-F.col("best.back")).cast("long").alias("start"), "best.shared", F.col("best.all").alias("total"),
                       (F.col("best.shared") / F.col("best.all")).alias("similarity"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the documents that leak an item."""
    gone = leaks(docs, benchmark, key=key, text=text).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[key] == F.col("gone"), "left_anti")


def oracle(source: str, percent: int = PERCENT) -> str:
    """DuckDB SQL: every window that holds a common shingle, whatever its start, compared in full."""
    signs = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    lower = f"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || {signs}, 'abcdefghijklmnopqrstuvwxyz     ')"
    cut = f"list_filter(string_split({lower}, ' '), lambda x: x <> '')"
    return f"""
with items as (select item_id, w, len(w) as length, least(len(w), {SHINGLE}) as size
               from (select item_id, {cut} as w from benchmark) where len(w) > 0),
isplit as (select item_id, length, size, unnest(range(1, length - size + 2)) as p, w from items),
ishingle as (select item_id, length, size, array_to_string(w[p:p + size - 1], ' ') as s, count(*) as c
             from isplit group by all),
itotal as (select item_id, sum(c) as total from ishingle group by all),
docs as (select doc_id, w, len(w) as n from (select doc_id, {cut} as w from {source}) where len(w) > 0),
sized as (select d.*, k.size from docs d, (select distinct size from items) k where n >= k.size),
dsplit as (select doc_id, n, size, unnest(range(1, n - size + 2)) as p, w from sized),
dshingle as (select doc_id, n, size, p - 1 as p, array_to_string(w[p:p + size - 1], ' ') as s from dsplit),
hits as (select d.*, i.item_id, i.length from dshingle d join ishingle i using (size, s)),
starts as (select distinct doc_id, item_id, n, length, size,
                  greatest(0, least(n - length, p - unnest(range(0, length - size + 1)))) as start from hits),
inside as (select t.doc_id, t.item_id, t.start, d.s, count(*) as c from starts t join dshingle d
           on d.doc_id = t.doc_id and d.size = t.size and d.p between t.start and t.start + t.length - t.size
           group by all),
summed as (select x.doc_id, x.item_id, x.start, sum(x.c) as total, sum(least(x.c, coalesce(i.c, 0))) as shared
           from inside x left join ishingle i on i.item_id = x.item_id and i.s = x.s group by all),
judged as (select doc_id, item_id, start, cast(shared as bigint) as shared,
                  cast(s.total + t.total - shared as bigint) as total
           from summed s join itotal t using (item_id)),
best as (select *, row_number() over (partition by doc_id, item_id order by -shared / total, start desc) as r
         from judged where 100 * shared >= {percent} * total)
select doc_id, item_id, cast(start as bigint) as start, shared, total, shared / total as similarity
from best where r = 1"""
