"""Price and promotion reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import share_percent
from ..operators.stats import DEFAULT_ACCURACY, SUMMARY_STATS, grouped_median, histogram, numeric_summary
from ..operators.value_cells import CELL, store_values, stored_moments, stored_quantiles


def paid_prices(catalog: DataFrame, c: str = "price") -> DataFrame:
    """Non-NULL, strictly positive prices (free products excluded)."""
    return catalog.select(c).filter(F.col(c).isNotNull() & (F.col(c) > 0))


def price_summary_minor(catalog: DataFrame, approx: bool = False, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Distribution summary of paid prices in minor units (cents)."""
    return numeric_summary(paid_prices(catalog, "price"), "price", approx, accuracy)


def price_summary_major(catalog: DataFrame, approx: bool = False, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Distribution summary of all prices in major units (euros)."""
    return numeric_summary(catalog.select("price_eur"), "price_eur", approx, accuracy)


def price_histogram(catalog: DataFrame, width: float = 500) -> DataFrame:
    """Paid prices (cents) per fixed-width bucket."""
    return histogram(paid_prices(catalog, "price"), "price", width).orderBy("bucket")


def discount_share(catalog: DataFrame) -> DataFrame:
    """One row: discounted products, all products, discounted percent
    (NULL on an empty catalog)."""
    return catalog.agg(
        F.count_if(F.col("discount") > 0).alias("n_discounted"),
        F.count(F.lit(1)).alias("n_total"),
    ).withColumn("share_percent", share_percent("n_discounted", "n_total"))


def price_by_genre(genres: DataFrame, approx: bool = False, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Per genre: rows, mean and median price in euros, highest median
    first. ``nb_games`` counts (product, genre) rows, not distinct products.
    The exact median never merges a whole genre in one task
    (:func:`~vitrine.operators.quantiles.exact_quantiles`), which reads the
    rows three times; counts and means come from its counting pass."""
    found = grouped_median(
        genres, ["genre"], "price_eur", "median_price_eur", approx, accuracy, count_col="nb_games", mean_col="avg_price_eur"
    )
    return found.select("genre", "nb_games", "avg_price_eur", "median_price_eur").orderBy(
        F.col("median_price_eur").desc_nulls_last(), F.col("genre").asc()
    )


def price_by_period(catalog: DataFrame, period_col: str = "covid_period") -> DataFrame:
    """Per release period: products, mean price (euros), mean discount."""
    return (
        catalog.groupBy(period_col)
        .agg(
            F.count(F.lit(1)).alias("nb_games"),
            F.avg("price_eur").alias("avg_price_eur"),
            F.avg("discount").alias("avg_discount"),
        )
        .orderBy(period_col)
    )



def store_genre_prices(genres: DataFrame, path: str) -> None:
    """Appends a load of (product, genre) rows to the stored price cells per genre and release year."""
    store_values(genres, ["genre", "release_year"], "price_eur", path)


def price_by_genre_stored(spark: SparkSession, path: str) -> DataFrame:
    """:func:`price_by_genre` of all loads, from the stored cells: totals, and the values of the cells that hold a median."""
    stats = stored_moments(spark, path, ["genre"]).select("genre", F.col("n_rows").alias("nb_games"), F.col("mean").alias("avg_price_eur"))
    medians = stored_quantiles(spark, path, [0.5], ["median_price_eur"], ["genre"])
    return (
        stats.join(medians, stats["genre"].eqNullSafe(medians["genre"]), "left")
        .select(stats["genre"], "nb_games", "avg_price_eur", "median_price_eur")
        .orderBy(F.col("median_price_eur").desc_nulls_last(), F.col("genre").asc())
    )


def store_prices(catalog: DataFrame, path: str) -> None:
    """Appends a load of products to the stored price cells (minor units) per release year."""
    store_values(catalog, ["release_year"], "price", path)


def price_summary_stored(spark: SparkSession, path: str) -> DataFrame:
    """:func:`price_summary_minor` (paid prices) of all loads, from the stored cells."""
    paid = F.col(CELL) > 0  # the cells of values above zero
    quartiles = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    exact = stored_quantiles(spark, path, list(quartiles.values()), list(quartiles), discrete=True, keep=paid)
    moments = stored_moments(spark, path, keep=paid).select(
        F.col("n").cast("double").alias("count"), "mean", "stddev", F.col("least").alias("min"), F.col("most").alias("max")
    )
    wide = moments.unionByName(exact, allowMissingColumns=True).agg(*[F.max(F.col(f"`{s}`")).alias(s) for s in SUMMARY_STATS])
    return wide.unpivot([], [F.col(f"`{s}`") for s in SUMMARY_STATS], "statistic", "value")
