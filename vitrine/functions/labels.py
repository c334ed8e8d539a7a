"""Label and flag expressions (searched CASE over columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnOrName, _col

# Period labels and the default inclusive bounds of the middle
# period.
PERIOD_LABELS = ("unknown", "pre_covid", "covid", "post_covid")
PERIOD_START = 2019
PERIOD_END = 2021

# Platform combinations. Each flag is (windows, mac, linux) as
# required values; the profile labels are checked in this order, anything
# else is "Others".
PLATFORM_FLAGS = {
    "is_windows_only": (True, False, False),
    "is_tri_platform": (True, True, True),
    "is_windows_mac": (True, True, False),
    "is_windows_linux": (True, False, True),
}
PROFILE_LABELS = [
    ("is_tri_platform", "Windows + macOS + Linux"),
    ("is_windows_mac", "Windows + macOS"),
    ("is_windows_linux", "Windows + Linux"),
    ("is_windows_only", "Windows only"),
]
PROFILE_DEFAULT = "Others"


def label_period(
    year: ColumnOrName,
    start: int = PERIOD_START,
    end: int = PERIOD_END,
    labels: tuple[str, str, str, str] = PERIOD_LABELS,
) -> Column:
    """NULL → labels[0]; < start → labels[1]; start..end (inclusive) →
    labels[2]; otherwise labels[3]."""
    y = _col(year)
    unknown, before, during, after = labels
    return (
        F.when(y.isNull(), F.lit(unknown))
        .when(y < start, F.lit(before))
        .when((y >= start) & (y <= end), F.lit(during))
        .otherwise(F.lit(after))
    )


def combination_flag(cols: list[ColumnOrName], required: tuple[bool, ...]) -> Column:
    """Three-valued conjunction ``c1 = r1 AND c2 = r2 ...`` (NULL if it
    depends on a NULL input)."""
    expr = None
    for c, want in zip(cols, required):
        term = _col(c) == F.lit(want)
        expr = term if expr is None else expr & term
    return expr


def profile_label(flags: list[tuple[str, str]] | None = None, default: str = PROFILE_DEFAULT) -> Column:
    """First flag column that is TRUE gives the label; NULL/FALSE fall through."""
    expr = None
    for flag, label in flags or PROFILE_LABELS:
        cond = F.col(flag)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))
