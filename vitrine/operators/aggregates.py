"""Generic aggregation operators.

All of them are hash aggregates with a partial (map-side) phase, so a hot key
-- even one holding a third of the rows -- reaches the shuffle as one partial
row per task. Distinct counts are planned by Spark as an aggregation on
(key, entity) first, which spreads a hot key over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_true, share_percent


def row_count(df: DataFrame, alias: str = "n_rows") -> DataFrame:
    """One row: number of rows (a distributed aggregate, not a driver count)."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def distinct_rows(df: DataFrame, cols: list[str], alias: str = "n_distinct") -> DataFrame:
    """One row: distinct combinations of ``cols`` (NULL counts as a value)."""
    return df.select(*cols).distinct().agg(F.count(F.lit(1)).alias(alias))


def count_by(df: DataFrame, key: str | Column, count_col: str = "count") -> DataFrame:
    """Rows per key; NULL is its own group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(count_col))


def distinct_with_null(c: str | Column) -> Column:
    """Distinct values of ``c`` where NULL counts as one value (like
    ``select(c).distinct().count()``), as one aggregate expression."""
    col = F.col(c) if isinstance(c, str) else c
    has_null = F.coalesce(F.max(F.when(col.isNull(), F.lit(1))), F.lit(0))
    return F.count_distinct(col) + has_null


def distinct_by_key(df: DataFrame, key: str, entity: str, alias: str) -> DataFrame:
    """Distinct entities per key (NULL entities ignored)."""
    return df.groupBy(key).agg(F.count_distinct(entity).alias(alias))


def conditional_counts(df: DataFrame, flags: dict[str, str | Column], total: str | None = None) -> DataFrame:
    """One row: count of TRUE rows per flag (NULL counts 0), optionally the
    row total. A single pass whatever the number of flags."""
    cols = [count_true(c).alias(name) for name, c in flags.items()]
    if total:
        cols.insert(0, F.count(F.lit(1)).alias(total))
    return df.agg(*cols)


def flag_shares(
    df: DataFrame,
    flags: dict[str, str | Column],
    label_col: str,
    count_col: str,
    share_col: str,
) -> DataFrame:
    """Long table (label, count, share of all rows in percent) from one
    global aggregate + ``unpivot``."""
    total = "__total"
    wide = conditional_counts(df, flags, total=total)
    labels = list(flags)
    return (
        wide.unpivot([total], [F.col(f"`{name}`") for name in labels], label_col, count_col)
        .select(label_col, count_col, share_percent(F.col(count_col), F.col(total)).alias(share_col))
    )
