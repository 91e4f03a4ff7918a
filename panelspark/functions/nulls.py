"""Null rules of cohort code that differ from plain SQL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_if(cond: Column, yes, no) -> Column:
    """``yes`` or ``no`` by ``cond``; an unknown condition gives NULL, not ``no``."""
    return F.when(cond, yes).when(~cond, no)


def cap_above(x, limit) -> Column:
    """Values over ``limit`` become ``limit``; NULL stays (``least`` would fill it)."""
    x = _col(x)
    return F.when(x > limit, F.lit(limit)).otherwise(x)


def cap_below(x, limit) -> Column:
    """Values under ``limit`` become ``limit``; NULL stays."""
    x = _col(x)
    return F.when(x < limit, F.lit(limit)).otherwise(x)


def in_set(x, values: Iterable) -> Column:
    """Membership that is never NULL: a missing value is in no set."""
    return F.coalesce(_col(x).isin(list(values)), F.lit(False))


def any_equal(columns: Iterable, value) -> Column:
    """True if any column equals ``value``; missing values count as unequal."""
    tests = [F.coalesce(_col(c) == value, F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, tests)


def null_if(x, token) -> Column:
    """Replace a missing-value token (or sentinel number) by NULL."""
    return F.nullif(_col(x), F.lit(token))


def null_where(x, cond: Column) -> Column:
    """NULL where ``cond`` holds; the value elsewhere, also for an unknown ``cond``."""
    return F.when(cond, F.lit(None)).otherwise(_col(x))


def fill_sentinel(x, *others, sentinel) -> Column:
    """First known value among ``x`` and ``others``, else ``sentinel``."""
    return F.coalesce(_col(x), *[_col(o) for o in others], F.lit(sentinel))


def strict_sum(columns: Iterable) -> Column:
    """Sum that is NULL as soon as one term is."""
    return reduce(lambda a, b: a + b, [_col(c) for c in columns])


def ratio(part, whole) -> Column:
    """``part / whole`` as double; NULL for a zero or missing ``whole``."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))
