"""DataFrame → DataFrame operators."""

from .aggregates import (
    conditional_counts,
    count_by,
    distinct_by_key,
    distinct_rows,
    distinct_with_null,
    flag_shares,
    row_count,
)
from .explode import explode_tokens
from .features import (
    normalize_numeric,
    prepare_catalog,
    with_age,
    with_genre_array,
    with_languages,
    with_major_units,
    with_period,
    with_platform_flags,
    with_platform_profile,
    with_release_date,
    with_release_parts,
    with_review_features,
)
from .flatten import FLAT_MAPPING, flatten_catalog, platform_view
from .quantiles import exact_quantiles
from .stats import grouped_median, histogram, median, numeric_summary
from .topk import preview, sort_stable, top_k

__all__ = [
    "FLAT_MAPPING",
    "conditional_counts",
    "count_by",
    "distinct_by_key",
    "distinct_rows",
    "distinct_with_null",
    "exact_quantiles",
    "explode_tokens",
    "flag_shares",
    "flatten_catalog",
    "histogram",
    "median",
    "normalize_numeric",
    "numeric_summary",
    "platform_view",
    "prepare_catalog",
    "preview",
    "grouped_median",
    "row_count",
    "sort_stable",
    "top_k",
    "with_age",
    "with_genre_array",
    "with_languages",
    "with_major_units",
    "with_period",
    "with_platform_flags",
    "with_platform_profile",
    "with_release_date",
    "with_release_parts",
    "with_review_features",
]
