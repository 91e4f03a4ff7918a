"""Recoding by rule lists, code maps, bins and level sets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.nulls import _col, in_set


def as_flag(cond: Column) -> Column:
    """Condition as 1 / 0 / NULL."""
    return cond.cast("int")


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Value of the first rule that is true; unknown conditions do not match."""
    (cond, value), *rest = rules
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def _literal_map(codes: Mapping) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in codes.items()))


def look_up(x, codes: Mapping) -> Column:
    """Value listed for a code; NULL for codes not listed."""
    return F.try_element_at(_literal_map(codes), _col(x))


def recode(x, codes: Mapping) -> Column:
    """Value listed for a code; codes not listed stay as they are."""
    return F.coalesce(look_up(x, codes), _col(x))


def right_closed_bins(x, breaks: Sequence, labels: Sequence[str]) -> Column:
    """Label of the bin ``(breaks[i], breaks[i + 1]]``; NULL outside all bins."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per bin")
    x = _col(x)
    bins = zip(breaks, breaks[1:], labels)
    return first_match([((x > low) & (x <= high), label) for low, high, label in bins])


def keep_levels(x, levels: Iterable) -> Column:
    """The value if it is a declared level, else NULL."""
    return F.when(in_set(x, levels), _col(x))
