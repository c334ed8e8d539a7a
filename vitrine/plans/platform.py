"""Platform reports: counts, shares, exclusive profiles, quality, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import conditional_counts, flag_shares
from ..operators.topk import top_k

# Display labels of the platform share table.
PLATFORM_LABELS = {"Windows": "platform_windows", "macOS": "platform_mac", "Linux": "platform_linux"}
TOP_PRODUCTS = 10


def platform_counts(catalog: DataFrame) -> DataFrame:
    """One row: products available on Windows, macOS, Linux (one pass)."""
    return conditional_counts(
        catalog,
        {"windows_count": "platform_windows", "mac_count": "platform_mac", "linux_count": "platform_linux"},
    )


def platform_share(catalog: DataFrame) -> DataFrame:
    """Three rows (platform, nb_games, share_percent of all products), from
    one distributed aggregate -- nothing computed on the driver."""
    return flag_shares(catalog, PLATFORM_LABELS, "platform", "nb_games", "share_percent")


def profile_counts(catalog: DataFrame) -> DataFrame:
    """One row: products per exclusive platform combination."""
    return conditional_counts(
        catalog,
        {
            "windows_only": "is_windows_only",
            "tri_platform": "is_tri_platform",
            "windows_mac": "is_windows_mac",
            "windows_linux": "is_windows_linux",
        },
    )


def profile_quality(catalog: DataFrame) -> DataFrame:
    """Per platform profile: distinct products, *unweighted* mean positive
    ratio, mean review count, mean price (minor units)."""
    return (
        catalog.groupBy("platform_profile")
        .agg(
            F.count_distinct("app_id").alias("nb_games"),
            F.avg("positive_ratio").alias("avg_positive_ratio"),
            F.avg("total_reviews").alias("avg_total_reviews"),
            F.avg("price").alias("avg_price"),
        )
        .orderBy(F.col("nb_games").desc(), F.col("platform_profile").asc())
    )


def top_by_reviews(catalog: DataFrame, flag: str, k: int = TOP_PRODUCTS) -> DataFrame:
    """Most reviewed products having ``flag``; ties broken by product id."""
    picked = catalog.filter(F.col(flag)).select("app_id", "name", "price", "total_reviews", "positive_ratio")
    return top_k(picked, ["-total_reviews"], k, tie_break=["app_id"])


def top_windows_only(catalog: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    return top_by_reviews(catalog, "is_windows_only", k)


def top_tri_platform(catalog: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    return top_by_reviews(catalog, "is_tri_platform", k)
