"""Analyses the original project describes in prose without coding them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import share_percent
from ..functions.tokens import is_present_token
from ..operators.ranks import rank_correlation
from .genre import genre_reviews

# Upper bounds (euros) of the price bands; the last band is open.
PRICE_BAND_EDGES = [5.0, 20.0, 40.0]


def _platform_pairs(catalog: DataFrame) -> DataFrame:
    """Number of supported platforms and positive ratio of every product."""
    n_platforms = sum(
        F.coalesce(F.col(c), F.lit(False)).cast("int")
        for c in ("platform_windows", "platform_mac", "platform_linux")
    )
    return catalog.select(n_platforms.alias("n_platforms"), "positive_ratio")


def ext_platform_corr(catalog: DataFrame) -> DataFrame:
    """Pearson correlation between the number of supported platforms and the
    positive ratio, over products having both (one global aggregate)."""
    pairs = _platform_pairs(catalog).filter(F.col("positive_ratio").isNotNull())
    return pairs.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.corr("n_platforms", "positive_ratio").alias("corr_platforms_ratio"),
    )


def ext_platform_rank_corr(catalog: DataFrame) -> DataFrame:
    """The same question by ranks: Spearman's coefficient, ties at their average rank. The number of platforms has four
    values, so it is all ties, which Pearson's coefficient reads as distances."""
    return rank_correlation(_platform_pairs(catalog), "n_platforms", "positive_ratio")


def ext_linux_genres(genres: DataFrame) -> DataFrame:
    """Genre review report restricted to products available on Linux."""
    return (
        genre_reviews(genres.filter(F.col("platform_linux")))
        .orderBy(F.col("positive_rate").desc_nulls_last(), F.col("genre").asc())
    )


def price_band(c: str = "price_eur", edges: list[float] | None = None):
    """Label ``"<lo>-<hi>"`` of the half-open band holding ``c``; ``"<last>+"``
    above the last edge."""
    edges = PRICE_BAND_EDGES if edges is None else edges
    x = F.col(c)
    expr = None
    lo = 0.0
    for hi in edges:
        label = F.lit(f"{lo:g}-{hi:g}")
        expr = F.when(x < hi, label) if expr is None else expr.when(x < hi, label)
        lo = hi
    return expr.otherwise(F.lit(f"{lo:g}+"))


def ext_price_bands(catalog: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """Review volume and satisfaction per price band, over reviewed, paid
    products (the population of the price ↔ success scatter)."""
    points = catalog.filter((F.col("total_reviews") > 0) & (F.col("price_eur") > 0))
    return (
        points.groupBy(price_band("price_eur", edges).alias("price_band"))
        .agg(
            F.count(F.lit(1)).alias("nb_games"),
            F.sum("total_reviews").alias("sum_total_reviews"),
            F.avg("total_reviews").alias("avg_total_reviews"),
            F.avg("positive_ratio").alias("avg_positive_ratio"),
        )
        .orderBy(F.col("sum_total_reviews").desc(), F.col("price_band").asc())
    )


def ext_genre_share(catalog: DataFrame) -> DataFrame:
    """Per genre: distinct products and their share of all distinct products
    of the catalog (products without a genre count in the denominator).

    Two aggregates over the product rows; the catalog-wide one is a single
    number, a scalar subquery of the other.
    """
    total = catalog.agg(F.count_distinct("app_id").alias("n_products"))
    per_genre = (
        catalog.select("app_id", F.explode("genre_array").alias("genre"))
        .filter(is_present_token("genre"))
        .groupBy("genre")
        .agg(F.count_distinct("app_id").alias("nb_games"))
    )
    return (
        per_genre.withColumn("n_products", total.scalar())
        .select("genre", "nb_games", "n_products", share_percent("nb_games", "n_products").alias("share_percent"))
        .orderBy(F.col("nb_games").desc(), F.col("genre").asc())
    )


def ext_top_languages(catalog: DataFrame) -> DataFrame:
    """Distinct products per language, the most represented first."""
    return (
        catalog.select("app_id", F.explode("languages_array").alias("language"))
        .withColumn("language", F.trim("language"))
        .filter(is_present_token("language"))
        .groupBy("language")
        .agg(F.count_distinct("app_id").alias("nb_games"))
        .orderBy(F.col("nb_games").desc(), F.col("language").asc())
    )
