"""Column functions for multi-valued text attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnOrName, _col

# Separators of the two multi-valued attributes. Languages are
# split on the bare comma (elements keep a leading blank), genres on a comma
# followed by any blanks.
LANGUAGE_SEPARATOR = ","
GENRE_SEPARATOR = r",\s*"


def split_tokens(c: ColumnOrName, sep_regex: str = GENRE_SEPARATOR) -> Column:
    """Text → array<string>; empty elements are kept, NULL stays NULL."""
    return F.split(_col(c), sep_regex)


def count_tokens(c: ColumnOrName) -> Column:
    """Array size; NULL array → NULL (not -1) whatever the ANSI setting."""
    arr = _col(c)
    return F.when(arr.isNotNull(), F.size(arr))


def is_present_token(c: ColumnOrName) -> Column:
    """Token is neither NULL nor the empty string."""
    tok = _col(c)
    return tok.isNotNull() & (tok != F.lit(""))
