"""Named reports composed from the operators."""

from . import charts, ext, genre, macro, platform, pricing
from .pipeline import (
    build_catalog,
    build_silver,
    catalog_for,
    catalog_from_json,
    checkpointed_catalog,
    genres_of,
)

__all__ = [
    "build_catalog",
    "build_silver",
    "catalog_for",
    "catalog_from_json",
    "charts",
    "checkpointed_catalog",
    "ext",
    "genre",
    "genres_of",
    "macro",
    "platform",
    "pricing",
]
