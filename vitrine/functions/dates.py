"""Column functions for cleaning and parsing free-text release dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnOrName, _col

# Accepted date layouts, tried in this order; the first that
# parses wins. (The two-digit-day variants are subsumed by the one-digit ones
# but kept so the list matches the original analysis.)
DEFAULT_DATE_FORMATS = [
    "MMM d yyyy",
    "MMM dd yyyy",
    "yyyy-MM-dd",
    "dd MMM yyyy",
    "d MMM yyyy",
]

# Text clean-up steps (pattern, replacement), applied in order:
# drop commas, unify "/" into "-", left-pad a lone digit after "-".
DATE_CLEANUP_STEPS = [
    (",", ""),
    ("/", "-"),
    (r"-(\d)(?!\d)", r"-0$1"),
]

_NUMBER = r"\d+"
_TEXT = r"[^\d\s]+"
_FIELD_SHAPES = {
    "y": r"[+-]?\d+",
    "u": r"[+-]?\d+",
    "d": _NUMBER,
    "D": _NUMBER,
    "H": _NUMBER,
    "h": _NUMBER,
    "k": _NUMBER,
    "K": _NUMBER,
    "m": _NUMBER,
    "s": _NUMBER,
    "S": _NUMBER,
    "E": _TEXT,
    "a": _TEXT,
}


def format_shape(fmt: str) -> str | None:
    """Regex every string accepted by the datetime pattern ``fmt`` matches.

    It is deliberately loose (any digit run for a number field, any letter
    run for a text field, any blank run for a blank), so it only rules out
    strings the pattern can never parse. ``None`` when the pattern uses a
    field this function does not know (no guard is then applied).
    """
    out = [r"^\s*"]
    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            end = fmt.find("'", i + 1)
            if end < 0:
                return None
            literal = fmt[i + 1 : end] or "'"
            out.append(re.escape(literal))
            i = end + 1
            continue
        if ch.isalpha():
            j = i
            while j < len(fmt) and fmt[j] == ch:
                j += 1
            run = j - i
            if ch in "ML":
                out.append(_NUMBER if run <= 2 else _TEXT)
            elif ch in _FIELD_SHAPES:
                out.append(_FIELD_SHAPES[ch])
            else:
                return None
            i = j
            continue
        out.append(r"\s+" if ch.isspace() else re.escape(ch))
        i += 1
    out.append(r"\s*$")
    return "".join(out)


def clean_date_text(c: ColumnOrName, steps: list[tuple[str, str]] | None = None) -> Column:
    """``"Oct 21, 2008"`` → ``"Oct 21 2008"``, ``"2000/11/1"`` → ``"2000-11-01"``."""
    out = _col(c)
    for pattern, replacement in DATE_CLEANUP_STEPS if steps is None else steps:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def parse_date_multi(c: ColumnOrName, formats: list[str] | None = None, guard: bool = True) -> Column:
    """First layout of ``formats`` that parses, else NULL (never an error).

    With ``guard`` each parser runs only where the text has the layout's
    shape (:func:`format_shape`): a failed parse is costly (the parser raises
    internally), a regex test is cheap, and the result is the same because
    the shape test never rejects a string the parser would accept.
    """
    col = _col(c)
    attempts = []
    for fmt in formats or DEFAULT_DATE_FORMATS:
        parsed = F.try_to_date(col, fmt)
        shape = format_shape(fmt) if guard else None
        attempts.append(F.when(col.rlike(shape), parsed) if shape else parsed)
    return F.coalesce(*attempts)
