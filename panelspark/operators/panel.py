"""Operators on the ordered visits of a person.

Grain: one row per (person, date). A person therefore holds no more rows than
there are calendar days in the study, which bounds every window below no matter
how the raw rows are spread; ``keys.collapse`` or ``keys.first_per_key`` on
(person, date) brings raw rows to that grain, combining repeats before they are
shuffled. All windows share one partitioning and one order, so a chain of these
operators costs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.dates import days_between, within_years
from panelspark.functions.nulls import _col, strict_sum
from panelspark.operators.keys import as_list


def person_order(key="id", order="visdate") -> WindowSpec:
    """Rows of one person in order, missing order values last."""
    return Window.partitionBy(*as_list(key)).orderBy(
        *[_col(o).asc_nulls_last() for o in as_list(order)]
    )


def so_far(w: WindowSpec) -> WindowSpec:
    """Frame of the rows up to and including the current one."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: WindowSpec) -> WindowSpec:
    """Frame of the rows strictly before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def after(w: WindowSpec) -> WindowSpec:
    """Frame of the rows strictly after the current one."""
    return w.rowsBetween(1, Window.unboundedFollowing)


def running_sum(x, w: WindowSpec, skip_nulls: bool = False) -> Column:
    """Running sum that is NULL from the first missing value on.

    ``skip_nulls`` treats missing values as nothing to add instead.
    """
    x = _col(x)
    total = F.sum(x).over(so_far(w))
    if skip_nulls:
        return total
    return F.when(F.sum(x.isNull().cast("int")).over(so_far(w)) == 0, total)


def is_first(flag, w: WindowSpec) -> Column:
    """1 on the first row whose 0/1 ``flag`` is set, else 0."""
    flag = F.coalesce(_col(flag).cast("int"), F.lit(0))
    return ((flag == 1) & (F.sum(flag).over(so_far(w)) == 1)).cast("int")


def visit_number(df: DataFrame, key="id", order="visdate", name: str = "n_vis") -> DataFrame:
    """Number the visits of each person from 1."""
    return df.withColumn(name, F.row_number().over(person_order(key, order)))


def with_previous(
    df: DataFrame, columns: Mapping[str, str], key="id", order="visdate", default=None
) -> DataFrame:
    """Add the previous row's value of each column (``{new: old}``).

    ``default`` stands for a missing row only; a missing value stays NULL.
    """
    w = person_order(key, order)
    return df.withColumns({new: F.lag(old, 1, default).over(w) for new, old in columns.items()})


def intervals(
    df: DataFrame, key="id", date: str = "visdate", start: str = "visdate0", gap: str = "gap_days"
) -> DataFrame:
    """Turn visits into intervals from the previous visit, with their length in days.

    The first visit of a person starts no interval and is dropped.
    """
    out = with_previous(df, {start: date}, key, date)
    return out.withColumn(gap, days_between(start, date)).filter(F.col(gap).isNotNull())


def close_pairs(
    df: DataFrame, key="id", date: str = "visdate", years: int = 1, name: str = "close"
) -> DataFrame:
    """Mark rows less than ``years`` calendar years after the person's previous row."""
    previous = F.lag(date).over(person_order(key, date))
    return df.withColumn(name, within_years(previous, date, years).cast("int"))


def mark_first(df: DataFrame, flag: str, name: str, key="id", order="visdate") -> DataFrame:
    """Add a 0/1 marker of the first row with ``flag`` set."""
    return df.withColumn(name, is_first(flag, person_order(key, order)))


def mark_confirmed(
    df: DataFrame,
    flags: Mapping[str, Column | str],
    key="id",
    date: str = "visdate",
    years: int = 1,
) -> DataFrame:
    """Mark the first confirmed episode of each measure: ``{marker: elevated flag}``.

    An elevated visit is confirmed when the person's previous *elevated* visit
    lies less than ``years`` calendar years back; normal visits between them do
    not matter. Each marker is 1 on the first such visit and 0 elsewhere. Dates
    ascend, so the previous elevated date is a running maximum and all measures
    are settled in one pass, with no filter and join back per measure.
    """
    w = person_order(key, date)
    high = {n: F.coalesce(_col(f).cast("boolean"), F.lit(False)) for n, f in flags.items()}
    out = df.withColumns(
        {f"_prev_{n}": F.max(F.when(h, F.col(date))).over(before(w)) for n, h in high.items()}
    )
    out = out.withColumns(
        {
            f"_pair_{n}": (h & within_years(f"_prev_{n}", date, years)).cast("int")
            for n, h in high.items()
        }
    )
    out = out.withColumns({n: is_first(f"_pair_{n}", w) for n in flags})
    return out.drop(*[f"_{p}_{n}" for n in flags for p in ("prev", "pair")])


def confirmed_episode(
    df: DataFrame, elevated: Column | str, key="id", date: str = "visdate", years: int = 1
) -> DataFrame:
    """The (person, date) at which an elevated measure is first confirmed."""
    out = mark_confirmed(df, {"_confirmed": elevated}, key, date, years)
    return out.filter(F.col("_confirmed") == 1).select(*as_list(key), date)


def absorbing(
    df: DataFrame,
    conditions: Mapping[str, Sequence[str]],
    key="id",
    order="visdate",
    skip_nulls: bool = False,
) -> DataFrame:
    """Ever-flags: ``{condition: 0/1 columns that trigger it}``.

    A condition is 1 from the first trigger on. A missing trigger makes it NULL
    from there on, unless ``skip_nulls``.
    """
    w = person_order(key, order)
    term = (lambda c: F.coalesce(F.col(c), F.lit(0))) if skip_nulls else F.col
    return df.withColumns(
        {
            name: (running_sum(strict_sum([term(c) for c in columns]), w) >= 1).cast("int")
            for name, columns in conditions.items()
        }
    )


def keep_through_first(df: DataFrame, flag: str, key="id", order="visdate") -> DataFrame:
    """Drop a person's rows after the first row with ``flag`` set; keep that row."""
    w = person_order(key, order)
    seen = F.coalesce(F.max(F.col(flag).cast("int")).over(before(w)), F.lit(0))
    return df.withColumn("_seen", seen).filter(F.col("_seen") == 0).drop("_seen")
