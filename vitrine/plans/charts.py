"""Chart feeds: row sets handed to a renderer (rendering itself is not built).

Unbounded feeds are plain projections/filters (they scale like the table);
the two inspection samples are keyed top-k so they are reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.flatten import platform_view
from ..operators.sampling import Density, bottom_k, density
from ..operators.topk import top_k
from .pricing import paid_prices

SAMPLE_ROWS = 20


def chart_platforms(catalog: DataFrame) -> DataFrame:
    """Platform booleans renamed for display, one row per product."""
    return platform_view(
        catalog,
        {"app_id": "app_id", "platform_windows": "Windows", "platform_mac": "Mac", "platform_linux": "Linux"},
    )


def chart_prices(catalog: DataFrame) -> DataFrame:
    """Paid prices (cents), one row per product."""
    return paid_prices(catalog, "price")


def chart_ages(catalog: DataFrame) -> DataFrame:
    return catalog.select("required_age")


def chart_languages(catalog: DataFrame) -> DataFrame:
    return catalog.select("num_languages")


def price_points(catalog: DataFrame) -> DataFrame:
    """Price ↔ success scatter: reviewed, paid products."""
    return catalog.select("app_id", "price_eur", "total_reviews", "positive_ratio").filter(
        (F.col("total_reviews") > 0) & (F.col("price_eur") > 0)
    )


def promotion_sample(catalog: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """First ``n`` discounted products by id."""
    discounted = catalog.filter(F.col("discount") > 0).select(
        "app_id", "name", "price_eur", "initialprice_eur", "discount"
    )
    return top_k(discounted, ["app_id"], n)


def chart_dates(catalog: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """Date cleaning sample: raw, cleaned and parsed text of ``n`` products."""
    cols = catalog.select("app_id", "release_date_raw", "release_date_clean", "release_date_parsed")
    return top_k(cols, ["app_id"], n)


DENSITY_CELLS = 400


def price_density(catalog: DataFrame, max_cells: int = DENSITY_CELLS, per_cell: int = 1) -> Density:
    """The price and success scatter at a bounded size: cells with counts, and a few products of each
    (:func:`~vitrine.operators.sampling.density`). Both axes are logarithms, of the price and of the reviews."""
    points = price_points(catalog).select(
        "app_id", F.round(F.log2("price_eur"), 9).alias("log_price"), F.round(F.log2("total_reviews"), 9).alias("log_reviews")
    )
    return density(points, "log_price", "log_reviews", "app_id", max_cells, per_cell)


def promotion_sample_by_profile(catalog: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """``n`` discounted products of each platform profile, drawn by hash, with the chance each had: not the oldest ids, and the same
    whatever the files."""
    discounted = catalog.filter(F.col("discount") > 0).select("platform_profile", "app_id", "name", "price_eur", "discount")
    return bottom_k(discounted, ["platform_profile"], "app_id", n)
