"""Date steps and monthly date runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def next_month(c) -> Column:
    """One month on, clamped to the end of a shorter month."""
    return F.add_months(c, 1)


def months_after(c, months) -> Column:
    """Date some months on; the end of a month goes to the end of a month, other days are clamped."""
    c = F.col(c) if isinstance(c, str) else c
    later = F.add_months(c, months)
    return F.when(c == F.last_day(c), F.last_day(later)).otherwise(later)


def monthly_date(start, step) -> Column:
    """``start`` moved on by whole months; a day the month lacks runs over into the next.

    From 30 May, step 9 is 2 March (or 1 March in a leap year), not 28 February.
    """
    start = F.col(start) if isinstance(start, str) else start
    first = F.add_months(F.trunc(start, "month"), step)
    return F.date_add(first, F.dayofmonth(start) - 1)


def monthly_dates(start, count: int) -> Column:
    """Array of ``count`` monthly dates beginning with ``start``."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: monthly_date(start, k))
