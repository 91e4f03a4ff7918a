"""Calendar arithmetic on dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.nulls import _col

DAYS_PER_YEAR = 365.25


def days_between(start, end) -> Column:
    """Whole days from ``start`` to ``end`` (negative when ``end`` is earlier)."""
    return F.datediff(_col(end), _col(start))


def years_between(start, end) -> Column:
    """Years of 365.25 days from ``start`` to ``end``, as double."""
    return days_between(start, end) / F.lit(DAYS_PER_YEAR)


def plus_days(date, n) -> Column:
    """``date`` shifted by ``n`` days."""
    return F.date_add(_col(date), n)


def plus_years(date, n: int) -> Column:
    """``date`` shifted by calendar years; 29 February falls back to the 28th."""
    return F.add_months(_col(date), 12 * n)


def within_years(earlier, later, n: int = 1) -> Column:
    """True when ``later`` lies less than ``n`` calendar years after ``earlier``.

    False, never NULL, when either date is missing.
    """
    return F.coalesce(_col(later) < plus_years(earlier, n), F.lit(False))


def year_range(date, first: int, last: int) -> Column:
    """Calendar years ``first..last`` as a date range.

    Comparing the column itself lets the filter reach the Parquet scan, which
    ``year(date) BETWEEN`` does not.
    """
    date = _col(date)
    return (date >= F.lit(dt.date(first, 1, 1))) & (date < F.lit(dt.date(last + 1, 1, 1)))
