"""Column functions for lenient numeric parsing and safe arithmetic.

All of them are built-in Spark expressions (JVM side, whole-stage codegen)
and give the same result with ``spark.sql.ansi.enabled`` on or off: a value
that cannot be parsed becomes NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_number(c: ColumnOrName, dtype: str = "double") -> Column:
    """Text or number → ``dtype``; unparsable input → NULL. Whole numbers may
    be written as decimals (``"5.0"`` → 5); ``"12.7"`` is no whole number."""
    if dtype not in ("bigint", "int"):
        return _col(c).try_cast(dtype)
    text = _col(c).cast("string")
    whole = F.regexp_extract(text, r"^\s*([+-]?\d+)\.0*\s*$", 1)
    return F.coalesce(text.try_cast(dtype), whole.try_cast(dtype))


def extract_int(c: ColumnOrName, pattern: str = r"(\d+)", group: int = 1) -> Column:
    """First match of ``pattern`` as int: ``"17+"`` → 17, ``"MA 18"`` → 18,
    no digits → NULL (the empty match is not a number)."""
    return F.regexp_extract(_col(c).cast("string"), pattern, group).try_cast("int")


def minor_to_major(c: ColumnOrName, factor: float = 100) -> Column:
    """Amount in minor units (cents) → major units (euros)."""
    return _col(c) / F.lit(factor)


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` as double when ``den > 0``, else NULL."""
    d = _col(den)
    return F.when(d > 0, _col(num).cast("double") / d)


def share_percent(part: ColumnOrName, total: ColumnOrName) -> Column:
    """``part / total * 100``; NULL when the total is 0 or NULL."""
    return safe_ratio(part, total) * F.lit(100.0)


def count_true(c: ColumnOrName) -> Column:
    """Rows where the boolean is TRUE (NULL and FALSE count 0); bigint."""
    return F.count_if(F.coalesce(_col(c), F.lit(False)))


def bucket_floor(c: ColumnOrName, width: float) -> Column:
    """Lower bound of the fixed-width bucket holding ``c`` (bigint); NULL where
    the bound is no bigint (NaN, infinities, huge values)."""
    x = _col(c).cast("double")
    bound = F.try_multiply(F.floor(x / F.lit(width)), F.lit(width)).try_cast("bigint")
    return F.when(~F.isnan(x), bound)
