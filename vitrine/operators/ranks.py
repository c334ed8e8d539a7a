"""Running totals, dense numbers and ranks over a whole table, without a window in one task.

``Window.orderBy`` without a partition sends every row to one task. Here rows are cut into key ranges that are summed side by
side; the ranges' totals, one row each, give every range the offset it starts from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Rows of a key range.
RANGE_ROWS = 1_000_000


def _order(keys: list[str]) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in keys]


def running_totals(
    df: DataFrame, keys: list[str], amount: str, out: str = "before", ranges: int | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """``df`` plus ``out``: the sum of ``amount`` (whole numbers) over the rows before this one in the order of ``keys``,
    nulls first. ``keys`` must tell rows apart; equal ones would fall in one range.

    One range shuffle and one by range number; the table in between is written to the shared folder. No task holds more
    than a range, and only the totals, one row a range, meet in one task.
    """
    number, within, start, total = "__t_range", "__t_within", "__t_start", "__t_total"
    if ranges is None:
        df = materialize(df, "totals-input")
        ranges = max(1, -(-df.count() // range_rows))
    dealt = df.repartitionByRange(ranges, *_order(keys)).withColumn(number, F.spark_partition_id())
    dealt = materialize(dealt, "totals-ranges")
    before = Window.partitionBy(number).orderBy(*_order(keys)).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(number).agg(F.sum(amount).alias(total))
    starts = sums.select(
        F.col(number).alias("__t_to"),
        F.coalesce(
            F.sum(total).over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias(start),
    )
    inside = dealt.withColumn(within, F.coalesce(F.sum(amount).over(before), F.lit(0)))
    return (
        inside.join(starts, F.col(number) == F.col("__t_to"))
        .withColumn(out, (F.col(within) + F.col(start)).cast("bigint"))
        .drop(number, within, start, "__t_to")
    )


def dense_numbers(df: DataFrame, keys: list[str], out: str = "number", start: int = 0, **params) -> DataFrame:
    """``df`` plus ``out``: its rows numbered gapless from ``start`` in the order of ``keys`` (which tell rows apart)."""
    one = "__t_one"
    numbered = running_totals(df.withColumn(one, F.lit(1)), keys, one, out, **params)
    return numbered.withColumn(out, F.col(out) + F.lit(start)).drop(one)


def average_ranks(df: DataFrame, column: str, weight: str | None = None, out: str = "rank", **params) -> DataFrame:
    """``column, n, out``: each distinct value of ``column`` (NULL left out), its rows, and the mean of the ranks from 1
    that its rows share. ``weight`` names a column of row counts if ``df`` is aggregated already.

    Rows are combined per value in the map tasks, so a value that most rows have is one row when ranges are cut.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(n.alias("n"))
    before = running_totals(values, [column], "n", "__t_before", **params)
    return before.select(column, "n", (F.col("__t_before") + (F.col("n") + 1) / 2).alias(out))


def rank_correlation(df: DataFrame, x: str, y: str, **params) -> DataFrame:
    """One row: ``n_pairs`` and ``rank_correlation``, Spearman's coefficient with average ranks for ties, over the rows that
    have both. NULL where one side does not vary. NaN ranks above every number.

    The rows are first counted per distinct (x, y), and these pairs meet their ranks; a pair that many rows
    share is one row.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("__t_n"))
    pairs = materialize(pairs.select(F.col(x).alias("x"), F.col(y).alias("y"), "__t_n"), "rank-pairs")
    ranked = pairs
    for side in ("x", "y"):
        ranks = average_ranks(pairs, side, "__t_n", f"r{side}", **params).drop("n")
        ranked = ranked.join(ranks, side)
    # moments about the mean rank, which is known: (n + 1) / 2
    total = pairs.agg(F.sum("__t_n")).scalar()
    dx, dy = F.col("rx") - (total + 1) / 2, F.col("ry") - (total + 1) / 2
    sums = ranked.agg(
        F.coalesce(F.sum("__t_n"), F.lit(0)).alias("n_pairs"),
        F.sum(F.col("__t_n") * dx * dy).alias("xy"),
        F.sum(F.col("__t_n") * dx * dx).alias("xx"),
        F.sum(F.col("__t_n") * dy * dy).alias("yy"),
    )
    spread = F.sqrt("xx") * F.sqrt("yy")
    return sums.select("n_pairs", F.when(spread > 0, F.col("xy") / spread).alias("rank_correlation"))
