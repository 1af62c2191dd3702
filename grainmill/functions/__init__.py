from .scalars import (
    chunk_array,
    deep_merge_maps,
    get_safe,
    is_empty,
    mape,
    normalize_string,
    parse_datetime,
    prevent_injection,
    safe_float,
    safe_int,
    sanitize_map,
    to_bool,
    trim_whitespace,
)

__all__ = [
    "chunk_array", "deep_merge_maps", "get_safe", "is_empty", "mape", "normalize_string",
    "parse_datetime", "prevent_injection", "safe_float", "safe_int", "sanitize_map", "to_bool",
    "trim_whitespace",
]
