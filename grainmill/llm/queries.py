"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import audit, bytespans, decontaminate, fingerprints, html, lines, lm, near, packing, quality, repeats, spelling, urls
from grainmill.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    heads = quality.fit(docs, table(spark, folder, "labels"))
    return quality.quality_verdicts(docs, heads, ["doc_id"])


@query("op9_line_dedup", lines.oracle("documents"))
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


@query("op1_benchmark_decontamination", decontaminate.oracle("documents"))
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op8_url_filter")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_verdicts(table(spark, folder, "pages").select("page_id", "url"), ["page_id"])


@query("op2_html_extraction")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"), ["page_id", "url"])


@query("op3_substring_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return bytespans.remove_repeated_bytes(table(spark, folder, "documents"))


@query("op10_lm_scoring")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents"))


@query("op13_filter_interaction_audit", audit.oracle("documents", "labels"))
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents"))


@query("op11_document_fingerprints")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, folder, "documents"))
