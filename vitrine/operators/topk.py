"""Stable ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(spec: str | Column) -> Column:
    """``"-x"`` → x DESC NULLS LAST, ``"x"`` → x ASC NULLS LAST."""
    if isinstance(spec, Column):
        return spec
    if spec.startswith("-"):
        return F.col(spec[1:]).desc_nulls_last()
    return F.col(spec).asc_nulls_last()


def sort_stable(df: DataFrame, order: list[str | Column], tie_break: list[str] | None = None) -> DataFrame:
    """Total order: the requested keys, then unique tie-break columns."""
    return df.orderBy(*[_key(o) for o in order], *[_key(t) for t in tie_break or []])


def top_k(df: DataFrame, order: list[str | Column], k: int, tie_break: list[str] | None = None) -> DataFrame:
    """First ``k`` rows of a total order.

    Planned as ``TakeOrderedAndProject``: each task keeps its own k best rows,
    only k × tasks rows reach the final merge, whatever the input size.
    """
    return sort_stable(df, order, tie_break).limit(k)


def preview(df: DataFrame, cols: list[str], n: int = 20, key: list[str] | None = None) -> DataFrame:
    """A reproducible look at ``n`` rows: the projection, ordered by ``key``
    (default: the first column) then cut -- a top-k, not an unordered limit."""
    return top_k(df.select(*cols), key or [cols[0]], n)
