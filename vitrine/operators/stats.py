"""Distribution operators: quantiles, summary statistics, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bucket_floor
from .quantiles import exact_quantiles

# Statistic names of the distribution summary, in report order.
SUMMARY_STATS = ["count", "mean", "stddev", "min", "25%", "50%", "75%", "max"]

DEFAULT_ACCURACY = 10000


def median(c: str, accuracy: int = DEFAULT_ACCURACY) -> Column:
    """Approximate median (fixed-size ``percentile_approx`` sketch per group)."""
    return F.percentile_approx(c, 0.5, accuracy).cast("double")


def grouped_median(
    df: DataFrame,
    groups: list[str],
    c: str,
    out: str,
    approx: bool = False,
    accuracy: int = DEFAULT_ACCURACY,
    count_col: str | None = None,
    mean_col: str | None = None,
) -> DataFrame:
    """Per group: median of ``c`` (interpolated, like ``percentile(c, 0.5)``),
    and the group's rows and the mean of ``c`` where these columns are named.

    Exact by default through :func:`exact_quantiles` (no group is merged in
    one task); ``approx=True`` uses the sketch alone.
    """
    if approx:
        more = [F.count(F.lit(1)).alias(count_col)] if count_col else []
        more += [F.avg(c).alias(mean_col)] if mean_col else []
        return df.groupBy(*groups).agg(*more, median(c, accuracy).alias(out))
    return exact_quantiles(df, c, [0.5], [out], groups, discrete=False, count_col=count_col, mean_col=mean_col)


def numeric_summary(
    df: DataFrame,
    c: str,
    approx: bool = False,
    accuracy: int = DEFAULT_ACCURACY,
    stat_col: str = "statistic",
    value_col: str = "value",
) -> DataFrame:
    """count, mean, stddev, min, quartiles, max of ``c`` as (statistic, value)
    rows; NULLs are ignored. Quartiles are ``percentile_disc`` values (real
    data values), exact through :func:`exact_quantiles` or, with
    ``approx=True``, from the sketch. Moments come from one global aggregate
    (partial per task); the wide row is turned into rows with ``unpivot`` --
    no driver round trip."""
    x = F.col(c)
    quartiles = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    moments = [
        F.count(x).cast("double").alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("stddev"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
    ]
    if approx:
        moments += [F.percentile_approx(c, p, accuracy).cast("double").alias(name) for name, p in quartiles.items()]
        wide = df.agg(*moments)
    else:
        # two single-row results side by side: union + aggregate (no join)
        exact = exact_quantiles(df, c, list(quartiles.values()), list(quartiles), discrete=True)
        parts = df.agg(*moments).unionByName(exact, allowMissingColumns=True)
        wide = parts.agg(*[F.max(F.col(f"`{s}`")).alias(s) for s in SUMMARY_STATS])
    return wide.unpivot([], [F.col(f"`{s}`") for s in SUMMARY_STATS], stat_col, value_col)


def histogram(df: DataFrame, c: str, width: float, bucket_col: str = "bucket", count_col: str = "count") -> DataFrame:
    """Rows per fixed-width bucket (``floor(x / width) * width``); NULL → no bucket."""
    return (
        df.filter(F.col(c).isNotNull())
        .groupBy(bucket_floor(c, width).alias(bucket_col))
        .agg(F.count(F.lit(1)).alias(count_col))
    )
