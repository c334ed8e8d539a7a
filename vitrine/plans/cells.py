"""Genre and platform reports from stored cells.

One pass over the product table leaves a table of cells, per (genre, release year, platform profile), with a bitmap of the products and
additive measures. Every report below rolls cells up and never touches products again; cells of a new load merge
with the stored ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_ratio
from ..operators.bitmaps import bitmap_cells, entity_numbers, merge_cells, roll_up, with_numbers
from ..session import materialize
from .genre import blockbusters
from .pipeline import genres_of

CELL_KEYS = ["release_year", "platform_profile"]
GENRE_KEYS = ["genre", *CELL_KEYS]
GENRE_MEASURES = {
    "n_rows": "count(1)",
    "sum_positive": "sum(positive)",
    "sum_negative": "sum(negative)",
    "sum_total_reviews": "sum(total_reviews)",
    "nb_windows": "count_if(platform_windows)",
    "nb_mac": "count_if(platform_mac)",
    "nb_linux": "count_if(platform_linux)",
}
MEANS = ["positive_ratio", "total_reviews", "price"]
PRODUCT_MEASURES = {
    **{f"sum_{c}": f"sum(double({c}))" for c in MEANS},
    **{f"n_{c}": f"count({c})" for c in MEANS},
}
# What cells are made of.
PRODUCT_COLUMNS = [
    "app_id", *CELL_KEYS, "genre_array", "positive", "negative", "total_reviews", "positive_ratio", "price",
    "platform_windows", "platform_mac", "platform_linux",
]


@dataclass
class Cells:
    """Product numbers and the two tables of cells, in the shared folder."""

    numbers: DataFrame
    genres: DataFrame
    products: DataFrame


def numbered_products(catalog: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(products with their numbers, all numbers)``, both written to the shared folder."""
    products = materialize(catalog.select(*PRODUCT_COLUMNS), "cell-products")
    numbers = materialize(entity_numbers(products, "app_id", CELL_KEYS, known=known), "product-numbers")
    return with_numbers(products, numbers, "app_id"), numbers


def store_cells(catalog: DataFrame, earlier: Cells | None = None) -> Cells:
    """Cells of the product table ``catalog``. With ``earlier`` its products are an additional load: they get numbers after the
    known ones (a product seen before keeps its number), and the stored cells merge with the new ones."""
    products, numbers = numbered_products(catalog, earlier.numbers if earlier else None)
    genre_cells = bitmap_cells(genres_of(products), GENRE_KEYS, GENRE_MEASURES)
    product_cells = bitmap_cells(products, CELL_KEYS, PRODUCT_MEASURES)
    if earlier:
        genre_cells = merge_cells([earlier.genres, genre_cells], GENRE_KEYS, list(GENRE_MEASURES))
        product_cells = merge_cells([earlier.products, product_cells], CELL_KEYS, list(PRODUCT_MEASURES))
    return Cells(numbers, materialize(genre_cells, "genre-cells"), materialize(product_cells, "product-cells"))


def genre_counts(cells: Cells) -> DataFrame:
    """Distinct products per genre, most represented first."""
    return roll_up(cells.genres, ["genre"], "nb_games", []).orderBy(F.desc("nb_games"), F.asc("genre"))


def genre_counts_by_year(cells: Cells) -> DataFrame:
    """Distinct products per genre and release year, from the same cells."""
    return roll_up(cells.genres, ["genre", "release_year"], "nb_games", []).orderBy("genre", "release_year")


def genre_reviews(cells: Cells) -> DataFrame:
    """Distinct products, review sums and the weighted positive rate per genre, most reviewed first."""
    sums = roll_up(cells.genres, ["genre"], "nb_games", ["sum_positive", "sum_negative", "sum_total_reviews"])
    return sums.withColumn("positive_rate", safe_ratio("sum_positive", "sum_total_reviews")).orderBy(
        F.col("sum_total_reviews").desc_nulls_last(), F.asc("genre")
    )


def genre_platforms(cells: Cells) -> DataFrame:
    """Per genre: distinct products, and rows available on each platform."""
    return roll_up(cells.genres, ["genre"], "nb_games", ["nb_windows", "nb_mac", "nb_linux"]).orderBy(
        F.desc("nb_games"), F.asc("genre")
    )


def profile_quality(cells: Cells) -> DataFrame:
    """Per platform profile: distinct products, and unweighted means from stored sums and counts."""
    sums = roll_up(cells.products, ["platform_profile"], "nb_games", list(PRODUCT_MEASURES))
    means = [F.when(F.col(f"n_{c}") > 0, F.col(f"sum_{c}") / F.col(f"n_{c}")).alias(f"avg_{c}") for c in MEANS]
    return sums.select("platform_profile", "nb_games", *means).orderBy(F.desc("nb_games"), F.asc("platform_profile"))


def blockbuster_genres(catalog: DataFrame, **thresholds) -> DataFrame:
    """Distinct blockbuster products per genre: the same bitmaps over the selected rows."""
    products, _ = numbered_products(catalog)
    cells = bitmap_cells(blockbusters(genres_of(products), **thresholds), ["genre"])
    return roll_up(cells, ["genre"], "nb_blockbusters", []).orderBy(F.desc("nb_blockbusters"), F.asc("genre"))
