"""Catalog-level reports: sizes, releases over time, ages, languages,
publishers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import is_present_token
from ..operators.aggregates import count_by
from ..operators.heavy import TRACKED, heavy_hitters
from ..operators.topk import top_k


def catalog_totals(catalog: DataFrame) -> DataFrame:
    """One row: product rows, distinct ids (NULL counts as a value) and
    distinct genres, and exploded genre rows -- in a single scan.

    Each product is exploded *outer* with its position, so the row at
    position 0 (or the lone row of a product without genres) stands for the
    product; the genre tokens come from the same rows. No join between a
    product-level and a genre-level aggregate is needed.
    """
    rows = catalog.select("id", F.posexplode_outer("genre_array").alias("pos", "genre"))
    is_product_row = F.col("pos").isNull() | (F.col("pos") == 0)
    null_id_seen = F.coalesce(F.max(F.when(is_product_row & F.col("id").isNull(), F.lit(1))), F.lit(0))
    return rows.agg(
        F.count_if(is_product_row).alias("n_rows"),
        (F.count_distinct(F.when(is_product_row, F.col("id"))) + null_id_seen).alias("n_ids"),
        F.count_distinct(F.when(is_present_token("genre"), F.col("genre"))).alias("n_genres"),
        F.count_if(is_present_token("genre")).alias("n_genre_rows"),
    )


def releases_per_year(catalog: DataFrame) -> DataFrame:
    return count_by(catalog, "release_year").orderBy(F.col("release_year").asc_nulls_first())


def releases_per_period(catalog: DataFrame, period_col: str = "covid_period") -> DataFrame:
    return count_by(catalog, period_col).orderBy(F.col(period_col).asc_nulls_first())


def age_distribution(catalog: DataFrame) -> DataFrame:
    return count_by(catalog, "required_age").orderBy(F.col("required_age").asc_nulls_first())


def language_distribution(catalog: DataFrame) -> DataFrame:
    return count_by(catalog, "num_languages").orderBy(F.col("num_languages").asc_nulls_first())


def top_publishers(catalog: DataFrame, k: int = 50) -> DataFrame:
    """Most prolific publishers (NULL publisher is a group); ties broken by
    name so the cut at ``k`` is deterministic."""
    return top_k(count_by(catalog, "publisher"), ["-count"], k, tie_break=["publisher"])


def top_publishers_heavy(catalog: DataFrame, k: int = 50, key: str = "publisher", tracked: int = TRACKED) -> DataFrame:
    """:func:`top_publishers` without one counted row per publisher (:func:`~vitrine.operators.heavy.heavy_hitters`):
    the same rows, for a ``key`` with any number of values."""
    return heavy_hitters(catalog, key, k, tracked=tracked).top
