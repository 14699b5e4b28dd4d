"""Text to typed values, three-valued conditions and text joining."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_number(c) -> Column:
    """Text as a double; text that is no number, and NaN, becomes NULL.

    The pattern turns away ``1d`` and ``1f``, which the cast alone accepts.
    """
    c = F.col(c) if isinstance(c, str) else c
    value = F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c.try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


def to_day(c, fmt: str = "M-d-yyyy") -> Column:
    """Text as a date; one-digit months and days are accepted, bad text becomes NULL."""
    return F.try_to_date(c, fmt)


def if_else(condition: Column, yes, no) -> Column:
    """``yes`` / ``no``, and NULL where the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)


def remove_text(c, text: str) -> Column:
    return F.replace(c, F.lit(text), F.lit(""))


def paste(*columns, sep: str = "") -> Column:
    """Join as text; a missing part appears as ``NA`` instead of voiding the result."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in columns]
    return F.concat_ws(sep, *parts)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)
