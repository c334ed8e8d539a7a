"""Column-level building blocks (all built-in Spark expressions, no UDFs)."""

from .dates import DEFAULT_DATE_FORMATS, clean_date_text, parse_date_multi
from .labels import combination_flag, label_period, profile_label
from .numeric import (
    bucket_floor,
    count_true,
    extract_int,
    minor_to_major,
    safe_ratio,
    share_percent,
    try_number,
)
from .tokens import count_tokens, is_present_token, split_tokens

__all__ = [
    "DEFAULT_DATE_FORMATS",
    "bucket_floor",
    "clean_date_text",
    "combination_flag",
    "count_tokens",
    "count_true",
    "extract_int",
    "is_present_token",
    "label_period",
    "minor_to_major",
    "parse_date_multi",
    "profile_label",
    "safe_ratio",
    "share_percent",
    "split_tokens",
    "try_number",
]
