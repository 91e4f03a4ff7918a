"""Text to number and date, with NULL for anything that does not parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.nulls import _col

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
YEAR = "^[0-9]{4}$"
# Year, month, day with any one separator between the parts, or none.
SPACED_DATE = r"^([0-9]{4})[-/. ]([0-9]{1,2})[-/. ]([0-9]{1,2})$"
PACKED_DATE = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"


def parse_number(text) -> Column:
    """Decimal text as double; NULL for other text.

    The pattern also keeps out Java literals such as ``12d``, and text that
    would cost a failed conversion per row.
    """
    text = F.trim(_col(text))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_ymd(text) -> Column:
    """Year-month-day text (``2011-01-05``, ``2011/1/5``, ``20110105``) as a date."""
    text = F.trim(_col(text).cast("string"))
    # Text in full ISO form skips the pattern work.
    iso = (
        (F.length(text) == 10)
        & (F.substring(text, 5, 1) == "-")
        & (F.substring(text, 8, 1) == "-")
    )
    dashed = F.regexp_replace(
        F.regexp_replace(text, PACKED_DATE, "$1-$2-$3"), SPACED_DATE, "$1-$2-$3"
    )
    other = F.when(dashed.rlike(SPACED_DATE), F.try_to_date(dashed, "yyyy-M-d"))
    return F.when(iso, text.try_cast("date")).otherwise(other)


def parse_year(text) -> Column:
    """Year of a possibly partial date: the first four characters as an integer."""
    head = F.substring(_col(text), 1, 4)
    return F.when(head.rlike(YEAR), head.try_cast("int"))
