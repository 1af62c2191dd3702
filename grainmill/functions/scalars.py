"""Scalar functions: Column in, Column out. All run JVM-side except Unicode NFKC."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted date layouts, tried in this order.
DATE_FORMATS = (
    "yyyy-M-d",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyy/M/d",
    "yyyy-M-d H:m:s",
    "d-MMM-yyyy",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
    "M/d/yy",
    "yyyy.M.d",
    "d-M-yyyy",
)
# Strings read as true; tokens removed from free text.
TRUE_WORDS = ("true", "yes", "1", "y")
DANGEROUS_TOKENS = r"(?i)(--|;|/\*|\*/|xp_|\bDROP\b|\bTABLE\b)"

NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_EDGE_SPACE = r"^\s+|\s+$"


_SHAPES = (("yyyy", r"\d{4}"), ("yy", r"\d{2}"), ("MMM", "[A-Za-z]{3}"), ("M", r"\d{1,2}"),
           ("d", r"\d{1,2}"), ("H", r"\d{1,2}"), ("m", r"\d{1,2}"), ("s", r"\d{1,2}"))


def layout_shape(fmt: str) -> str:
    """Regex of the texts a layout can parse; failed parses are dear, a regex test is not."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "'":
            end = fmt.index("'", i + 1)
            out, i = out + fmt[i + 1:end], end + 1
            continue
        token, shape = next(((t, s) for t, s in _SHAPES if fmt.startswith(t, i)), (fmt[i], None))
        out, i = out + (shape or re.escape(token)), i + len(token)
    return f"^{out}$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def parse_datetime(c: Column, tz: str = "UTC", formats: Sequence[str] = DATE_FORMATS,
                   numeric: bool = False) -> Column:
    """Text (first matching layout, then ISO-8601) or epoch seconds to a UTC wall-clock timestamp.

    Values without a zone are taken to be in `tz`; ISO text with an offset keeps its own.
    """
    here = F.current_timezone()
    if numeric:
        instant = F.timestamp_seconds(c.cast("double"))
        return F.convert_timezone(here, F.lit("UTC"), instant.cast("timestamp_ntz"))
    text = _strip(c)

    def attempt(fmt: str) -> Column:
        parsed = F.when(text.rlike(layout_shape(fmt)),
                        F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))
        if "yyyy" in fmt:
            return parsed
        # two-digit years pivot at 69, as in POSIX
        century = F.make_interval(years=F.lit(100))
        return F.when(F.year(parsed) >= 2069, parsed - century).otherwise(parsed)

    local = F.coalesce(*[attempt(f) for f in formats],
                       F.when(~text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"),
                              text.try_cast("timestamp_ntz")))
    zoned = F.convert_timezone(here, F.lit("UTC"),
                               text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.coalesce(F.convert_timezone(F.lit(tz), F.lit("UTC"), local),
                      F.when(text.rlike(r"^\d{4}-\d"), zoned))


@F.pandas_udf(T.StringType())  # a type object: no session is needed at import
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def normalize_string(c: Column, lower: bool = True, strip: bool = True,
                     ascii_only: bool = False) -> Column:
    """NFKC, trim, lower. Only text with a non-ASCII character crosses into Python."""
    special = c.rlike(r"[^\x00-\x7F]")
    out = F.coalesce(_nfkc(F.when(special, c)), c)
    if strip:
        out = _strip(out)
    if lower:
        out = F.lower(out)
    if ascii_only:
        out = F.regexp_replace(out, r"[^\x00-\x7F]", "")
    return out


def nfkc_literal(text: str) -> str:
    """Driver-side twin for names and parameters."""
    return unicodedata.normalize("NFKC", text)


def trim_whitespace(c: Column) -> Column:
    return F.regexp_replace(_strip(c), r"\s+", " ")


def prevent_injection(c: Column) -> Column:
    """Text sanitiser only; SQL goes through bound parameters."""
    return F.replace(F.regexp_replace(c, DANGEROUS_TOKENS, ""), F.lit("'"), F.lit("''"))


def sanitize_map(m: Column, sanitizer: Callable[[Column], Column] = trim_whitespace) -> Column:
    """Apply a Column function to every value of a map<string,string>."""
    return F.transform_values(m, lambda _, v: sanitizer(v))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def to_bool(c: Column, default: bool = False, text: bool = True) -> Column:
    if text:
        return F.coalesce(F.lower(_strip(c)).isin(*TRUE_WORDS), F.lit(default))
    return F.coalesce(c.try_cast("bigint") != 0, F.lit(default))


def get_safe(json_text: Column, keys: str | Sequence[str], default: str | None = None) -> Column:
    """Value at a path of JSON text, or the default where the path is absent."""
    path = [keys] if isinstance(keys, str) else list(keys)
    return F.coalesce(F.get_json_object(json_text, "$." + ".".join(path)), F.lit(default))


def deep_merge_maps(a: Column, b: Column, depth: int = 1) -> Column:
    """Merge two maps, right side winning; `depth` > 1 merges nested maps too."""

    def pick(_, x: Column, y: Column) -> Column:
        if depth > 1:
            return F.when(x.isNotNull() & y.isNotNull(),
                          deep_merge_maps(x, y, depth - 1)).otherwise(F.coalesce(y, x))
        return F.coalesce(y, x)

    return F.map_zip_with(a, b, pick)


def is_empty(c: Column, collection: bool = False) -> Column:
    return c.isNull() | ((F.size(c) if collection else F.length(c)) == 0)


def chunk_array(a: Column, size: int) -> Column:
    pieces = F.ceil(F.size(a) / F.lit(size)).cast("int")
    starts = F.when(pieces > 0, F.sequence(F.lit(0), pieces - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i * size + 1, size))


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error; zero actuals are skipped."""
    error = F.abs((actual - predicted) / F.nullif(actual, F.lit(0.0)))
    return F.avg(error) * 100
