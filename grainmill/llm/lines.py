"""Line dedup by distinct-site spread: lines that many sites share stay only where they first appear.

Each line (trimmed, blank ones apart) gets a HyperLogLog sketch of the sites it appears on; sketches merge in the
aggregation, so a line on every page of the corpus costs one buffer per task. The sketch decides when its estimate
is clear of `min_sites`; lines whose estimate is within a factor of two get an exact distinct count. A line on
`min_sites` sites or more is kept in the row with the smallest (doc_id, line number) and removed everywhere else.

A null text has no lines and stays null. A null site adds no site. Rows equal in id and text are treated alike, so
repeated rows keep or lose the same lines. Removal leaves the other lines as they were, joined by line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 10
SKETCH_BITS = 12
BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def all_lines(docs: DataFrame, text: str, site: str, key: str) -> DataFrame:
    """(doc, site, number, line key) of every line that is not blank."""
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), F.col(site).cast("string").alias("site"), F.xxhash64(text).alias("version"),
        F.posexplode(F.split(F.col(text), "\n")).alias("number", "line"))
    return rows.filter(F.btrim("line", F.lit(BLANKS)) != "").select(
        "doc", "version", "site", "number", line_key(F.col("line")).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first) of the lines on `min_sites` sites or more; first is their smallest (doc, number)."""
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.min(F.struct("doc", "number")).alias("first"))
    judged = sketched.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites")) \
        .filter(F.col("sites") * 2 >= min_sites)
    sure = judged.filter(F.col("sites") >= 2 * min_sites).select("line", "first")
    near = judged.filter(F.col("sites") < 2 * min_sites).select("line", "first")
    exact = (lines.join(near.select("line"), "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites))
    return sure.unionByName(near.join(exact.select("line"), "line", "left_semi"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source",
                key: str = "doc_id") -> DataFrame:
    """All columns with the cleaned `text`, and `n_lines`, `n_removed` (lines that are not blank; these names win)."""
    lines = all_lines(docs, text, site, key)
    extra = (lines.join(spread_lines(lines, min_sites), "line")
             .filter(~F.col("first").eqNullSafe(F.struct("doc", "number")))
             .groupBy("doc", "version").agg(F.collect_set("number").alias("drop")))
    base = docs.drop("n_lines", "n_removed").select("*", F.xxhash64(text).alias("  version"))
    joined = base.join(extra, F.col(key).eqNullSafe(F.col("doc")) & (F.col("  version") == F.col("version")), "left")
    pieces = F.split(F.col(text), "\n")
    # Positions are subtracted as a set, then the pieces are picked: linear in the number of lines.
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("drop")),
                                    lambda i: F.get(pieces, i)), "\n")
    filled = F.size(F.filter(pieces, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return joined.select(
        *[F.when(F.col("drop").isNull(), F.col(text)).otherwise(left).alias(c) if c == text else F.col(f"`{c}`")
          for c in base.columns if c != "  version"],
        F.when(F.col(text).isNull(), 0).otherwise(filled).cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_removed"))


def oracle(source: str, min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for (doc_id, n_lines, n_removed, text) of `source`."""
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
with cut as (select doc_id, source, unnest(string_split(text, chr(10))) as line,
                    generate_subscripts(string_split(text, chr(10)), 1) as number from {source} where text is not null),
filled as (select *, trim(line, {blanks}) as name from cut),
spread as (select name, min({{'d': doc_id, 'n': number}}) as first from filled where name <> ''
           group by name having count(distinct source) >= {min_sites}),
marked as (select f.*, s.name is not null and first <> {{'d': doc_id, 'n': number}} as gone
           from filled f left join spread s using (name))
select d.doc_id, count(*) filter (name <> '') as n_lines, count(*) filter (gone) as n_removed,
       case when any_value(d.text) is null then null
            else coalesce(string_agg(line, chr(10) order by number) filter (not gone), '') end as text
from {source} d left join marked m on d.doc_id = m.doc_id group by d.doc_id"""
