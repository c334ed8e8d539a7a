"""Feature stages of the product table.

Every stage is ``f(df, **params) -> DataFrame`` made of one ``withColumns``
projection, so stages chain with ``DataFrame.transform`` and Catalyst merges
them into a single scan-side projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_DATE_FORMATS, clean_date_text, parse_date_multi
from ..functions.labels import (
    PERIOD_END,
    PERIOD_START,
    PLATFORM_FLAGS,
    combination_flag,
    label_period,
    profile_label,
)
from ..functions.numeric import extract_int, minor_to_major, safe_ratio, try_number
from ..functions.tokens import GENRE_SEPARATOR, LANGUAGE_SEPARATOR, count_tokens, split_tokens

# Typed column ← (raw column, target type).
NUMERIC_SPEC = {
    "price": ("price_raw", "double"),
    "initialprice": ("initialprice_raw", "double"),
    "discount": ("discount_raw", "double"),
    "positive": ("positive_raw", "bigint"),
    "negative": ("negative_raw", "bigint"),
    "ccu": ("ccu", "bigint"),
    "app_id": ("app_id", "bigint"),
}


def normalize_numeric(df: DataFrame, spec: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Raw values → typed numbers; unparsable values become NULL."""
    spec = NUMERIC_SPEC if spec is None else spec
    return df.withColumns({out: try_number(src, dtype) for out, (src, dtype) in spec.items()})


def with_age(df: DataFrame, src: str = "required_age_raw") -> DataFrame:
    """``required_age_str`` (text) and ``required_age`` (first integer)."""
    text = F.col(src).cast("string")
    return df.withColumns({"required_age_str": text, "required_age": extract_int(text)})


def with_major_units(
    df: DataFrame,
    cols: dict[str, str] | None = None,
    factor: float = 100,
) -> DataFrame:
    """Minor-unit amounts → major units; the originals are kept."""
    cols = cols or {"price_eur": "price", "initialprice_eur": "initialprice"}
    return df.withColumns({out: minor_to_major(src, factor) for out, src in cols.items()})


def with_release_date(
    df: DataFrame,
    src: str = "release_date_raw",
    formats: list[str] | None = None,
) -> DataFrame:
    """``release_date_clean`` (normalised text) and ``release_date_parsed``."""
    df = df.withColumn("release_date_clean", clean_date_text(src))
    return df.withColumn(
        "release_date_parsed", parse_date_multi("release_date_clean", formats or DEFAULT_DATE_FORMATS)
    )


def with_release_parts(df: DataFrame, src: str = "release_date_parsed") -> DataFrame:
    """``release_year`` and ``release_month`` (NULL date → NULL parts)."""
    return df.withColumns({"release_year": F.year(src), "release_month": F.month(src)})


def with_period(
    df: DataFrame,
    year: str = "release_year",
    out: str = "covid_period",
    start: int = PERIOD_START,
    end: int = PERIOD_END,
) -> DataFrame:
    return df.withColumn(out, label_period(year, start, end))


def with_review_features(df: DataFrame, pos: str = "positive", neg: str = "negative") -> DataFrame:
    """``total_reviews`` = pos + neg (NULL if either is NULL) and
    ``positive_ratio`` = pos / total when total > 0, else NULL."""
    total = F.try_add(pos, neg).try_cast("bigint")
    return df.withColumn("total_reviews", total).withColumn(
        "positive_ratio", safe_ratio(pos, "total_reviews")
    )


def with_languages(df: DataFrame, src: str = "languages_raw") -> DataFrame:
    """``languages_array`` (split on the bare comma) and ``num_languages``."""
    return df.withColumn("languages_array", split_tokens(src, LANGUAGE_SEPARATOR)).withColumn(
        "num_languages", count_tokens("languages_array")
    )


def with_genre_array(df: DataFrame, src: str = "genre_raw") -> DataFrame:
    return df.withColumn("genre_array", split_tokens(src, GENRE_SEPARATOR))


def with_platform_flags(
    df: DataFrame,
    windows: str = "platform_windows",
    mac: str = "platform_mac",
    linux: str = "platform_linux",
) -> DataFrame:
    """The four exclusive platform combination flags (three-valued)."""
    cols = [windows, mac, linux]
    return df.withColumns({name: combination_flag(cols, req) for name, req in PLATFORM_FLAGS.items()})


def with_platform_profile(df: DataFrame, out: str = "platform_profile") -> DataFrame:
    return df.withColumn(out, profile_label())


def prepare_catalog(
    flat: DataFrame,
    period_start: int = PERIOD_START,
    period_end: int = PERIOD_END,
    date_formats: list[str] | None = None,
) -> DataFrame:
    """Flat raw table → full product table (the "silver" contract)."""
    return (
        flat.transform(normalize_numeric)
        .transform(with_age)
        .transform(with_major_units)
        .transform(with_release_date, formats=date_formats)
        .transform(with_release_parts)
        .transform(with_period, start=period_start, end=period_end)
        .transform(with_review_features)
        .transform(with_languages)
        .transform(with_genre_array)
        .transform(with_platform_flags)
        .transform(with_platform_profile)
    )
