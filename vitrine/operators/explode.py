"""One product → one row per token of a multi-valued attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import is_present_token


def explode_tokens(
    df: DataFrame,
    array_col: str = "genre_array",
    out: str = "genre",
    keep: list[str] | None = None,
) -> DataFrame:
    """Bridge table: one row per (product, token); NULL arrays give no row,
    NULL and empty tokens are dropped. A token repeated in one product gives
    repeated rows (entity counts use distinct product ids).

    ``keep`` restricts the carried columns (default: all but the array).
    Explode is a narrow operator: no shuffle, and Catalyst prunes unused
    columns below it.
    """
    carried = keep if keep is not None else [c for c in df.columns if c != array_col]
    return df.select(*carried, F.explode(array_col).alias(out)).filter(is_present_token(out))
