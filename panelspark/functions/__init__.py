"""Column expressions. Every function maps columns to a column; none is a UDF."""

from panelspark.functions.dates import (
    days_between,
    plus_days,
    plus_years,
    within_years,
    year_range,
    years_between,
)
from panelspark.functions.nulls import (
    any_equal,
    cap_above,
    cap_below,
    fill_sentinel,
    in_set,
    null_if,
    null_where,
    ratio,
    strict_if,
    strict_sum,
)
from panelspark.functions.parse import parse_number, parse_year, parse_ymd
from panelspark.functions.recode import (
    as_flag,
    first_match,
    keep_levels,
    look_up,
    recode,
    right_closed_bins,
)

__all__ = [
    "any_equal", "as_flag", "cap_above", "cap_below", "days_between", "fill_sentinel",
    "first_match", "in_set", "keep_levels", "look_up", "null_if", "null_where", "parse_number",
    "parse_year", "parse_ymd", "plus_days", "plus_years", "ratio", "recode",
    "right_closed_bins", "strict_if", "strict_sum", "within_years", "year_range",
    "years_between",
]
