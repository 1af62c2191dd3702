"""Personal data: detection with offsets, masking, audit. No Python UDF is involved."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import require_columns, text_columns

# Detection patterns, in detection order.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(\+?\d{1,3}[-.\s]?)?(\(?\d{2,4}\)?[-.\s]?)?\d{3}[-.\s]?\d{4,6}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
# Replacement tokens.
TOKENS = {
    "email": "<EMAIL_REDACTED>",
    "phone": "<PHONE_REDACTED>",
    "ssn": "<SSN_REDACTED>",
    "credit_card": "<CREDIT_CARD_REDACTED>",
    "ip_address": "<IP_REDACTED>",
}
REDACTED = "[REDACTED]"
# A cheap test every match of a pattern must pass; texts that fail it skip the full pattern.
GUARDS = {"email": "@", "phone": r"\d{3}[-.\s]?\d{4}", "ssn": r"\d-\d{2}-\d", "ip_address": r"\d\.\d"}
# Whole-column masking by name, and in-text patterns of the cleaning step.
NAME_KEYWORDS = ("email", "phone", "ssn", "name", "dob", "address")
MASK = "***MASKED***"
STEP_EMAIL = r"[^@]+@[^@]+\.[^@]+"
STEP_PHONE = r"\b\d{3}[-.\s]??\d{3}[-.\s]??\d{4}\b"
STEP_SSN = r"\b\d{3}-\d{2}-\d{4}\b"

HASHES = {"md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224),
          "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384),
          "sha512": lambda c: F.sha2(c, 512)}
STRATEGIES = ("redact", "token", "hash")


def _spans(c: Column, pii_type: str, order: int) -> Column:
    """array<struct<start, order, pii_type, match>>; starts follow from the text between matches."""
    pattern = PATTERNS[pii_type]
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    between = F.split(c, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["end"] + F.length(pair["gap"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"),
                        F.lit(pii_type).alias("pii_type"), pair["match"].alias("match"))
        return F.struct((start + F.length(pair["match"])).alias("end"),
                        F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)),
                       lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(
        "array<struct<start:int,order:int,pii_type:string,match:string>>").alias("spans"))
    spans = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    none = F.array().cast("array<struct<start:int,order:int,pii_type:string,match:string>>")
    return F.when(c.rlike(GUARDS.get(pii_type, pattern)), spans).otherwise(none)


def pii_spans(c: Column, pii_types: Sequence[str] | None = None) -> Column:
    """All matches of a text, by start and then by type order."""
    kinds = list(pii_types or PATTERNS)
    unknown = [k for k in kinds if k not in PATTERNS]
    if unknown:
        raise ValueError(f"unknown PII types: {unknown}")
    return F.array_sort(F.concat(*[_spans(c, k, i) for i, k in enumerate(kinds)]))


def detect(df: DataFrame, row_id: Sequence[str], columns: Sequence[str] | None = None,
           pii_types: Sequence[str] | None = None) -> DataFrame:
    """(row_id, column, pii_type, match, start, end), ends exclusive."""
    columns = [c for c in (columns or text_columns(df)) if columns or c not in row_id]
    require_columns(df, [*row_id, *columns])
    found = F.array(*[F.struct(F.lit(c).alias("column"), pii_spans(F.col(c), pii_types).alias("spans"))
                      for c in columns])
    spans = (df.select(*row_id, F.explode(found).alias("f"))
               .select(*row_id, F.col("f.column").alias("column"), F.explode("f.spans").alias("s")))
    start = F.col("s.start")
    return spans.select(*row_id, "column", F.col("s.pii_type").alias("pii_type"),
                        F.col("s.match").alias("match"), start.alias("start"),
                        (start + F.length("s.match")).alias("end"))


def _replacement(span: Column, strategy: str, tokens: Mapping[str, str], hash_algo: str) -> Column:
    if strategy == "redact":
        return F.lit(REDACTED)
    if strategy == "hash":
        return HASHES[hash_algo](span["match"].cast("binary"))
    literal = F.create_map(*[x for k, v in tokens.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(literal, span["pii_type"])


def mask_text(c: Column, strategy: str = "redact", pii_types: Sequence[str] | None = None,
              tokens: Mapping[str, str] | None = None, hash_algo: str = "sha256") -> Column:
    """Replace each match, in order of appearance, everywhere it occurs in the text."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if hash_algo not in HASHES:
        raise ValueError(f"hash must be one of {sorted(HASHES)}")
    table = {**TOKENS, **(tokens or {})}
    return F.aggregate(pii_spans(c, pii_types), c, lambda acc, s: F.replace(
        acc, s["match"], _replacement(s, strategy, table, hash_algo)))


def mask(df: DataFrame, columns: Sequence[str] | None = None, **options: object) -> DataFrame:
    """Mask text columns (all by default); runs on batch and streaming DataFrames."""
    columns = list(columns or text_columns(df))
    require_columns(df, columns)
    return df.withColumns({c: mask_text(F.col(c), **options) for c in columns})


def audit(df: DataFrame, row_id: Sequence[str], columns: Sequence[str] | None = None,
          **options: object) -> DataFrame:
    """(row_id, column, original_value, masked_value, pii_type, match).

    Holds the raw personal data, so it is computed only when asked for.
    """
    columns = [c for c in (columns or text_columns(df)) if columns or c not in row_id]
    kinds = options.get("pii_types")
    parts = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).alias("original_value"),
        mask_text(F.col(c), **options).alias("masked_value"),
        pii_spans(F.col(c), kinds).alias("spans")) for c in columns])
    rows = df.select(*row_id, F.explode(parts).alias("p")).select(*row_id, "p.*")
    return (rows.withColumn("s", F.explode("spans"))
                .select(*row_id, "column", "original_value", "masked_value",
                        F.col("s.pii_type").alias("pii_type"), F.col("s.match").alias("match")))


def mask_columns(df: DataFrame, columns: Sequence[str], text: str = MASK) -> DataFrame:
    """Replace whole values of the named columns, keeping nulls."""
    require_columns(df, columns)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(text)) for c in columns})


def mask_by_name(df: DataFrame, keywords: Sequence[str] = NAME_KEYWORDS) -> DataFrame:
    """Mask columns whose name suggests personal data; search the other text columns by pattern.

    The email pattern takes everything around an @. Anchoring it where a run without @ begins
    finds the same matches and keeps the search linear on long texts.
    """
    email = "(?<![^@])" + STEP_EMAIL.replace("[^@]+@", "[^@]++@", 1)
    named = [c for c in df.columns if any(k in c.lower() for k in keywords)]
    texts = [c for c in text_columns(df) if c not in named]
    literal = MASK.replace("$", r"\$")

    def clean(c: str) -> Column:
        return reduce(lambda v, p: F.regexp_replace(v, p, literal), (email, STEP_PHONE, STEP_SSN),
                      F.col(c))

    out = mask_columns(df, named) if named else df
    return out.withColumns({c: clean(c) for c in texts}) if texts else out
