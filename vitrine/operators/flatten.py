"""Flatten the nested raw record into the flat product table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Flat column name → path in the raw record.
FLAT_MAPPING = {
    "id": "id",
    "app_id": "data.appid",
    "name": "data.name",
    "genre_raw": "data.genre",
    "publisher": "data.publisher",
    "developer": "data.developer",
    "type": "data.type",
    "price_raw": "data.price",
    "initialprice_raw": "data.initialprice",
    "discount_raw": "data.discount",
    "required_age_raw": "data.required_age",
    "positive_raw": "data.positive",
    "negative_raw": "data.negative",
    "languages_raw": "data.languages",
    "owners_raw": "data.owners",
    "ccu": "data.ccu",
    "platform_linux": "data.platforms.linux",
    "platform_mac": "data.platforms.mac",
    "platform_windows": "data.platforms.windows",
    "release_date_raw": "data.release_date",
}


def flatten_catalog(
    df: DataFrame,
    mapping: dict[str, str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One projection extracting every mapped path (any nesting depth).

    ``keep`` lists source columns to carry along unchanged (for example the
    original ``data`` struct). On Parquet input only the leaves named in the
    mapping are read (nested schema pruning).
    """
    mapping = FLAT_MAPPING if mapping is None else mapping
    cols = [F.col(path).alias(name) for name, path in mapping.items()]
    cols += [F.col(c) for c in keep or [] if c not in mapping]
    return df.select(*cols)


def platform_view(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rename projection of the platform booleans (chart feed)."""
    names = names or {"platform_windows": "Windows", "platform_mac": "Mac", "platform_linux": "Linux"}
    return df.select(*[F.col(src).alias(dst) for src, dst in names.items()])
