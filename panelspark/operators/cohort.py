"""From visits to follow-up intervals with states.

Input grain: one row per (person, date), see ``operators.panel``. Deaths hold one
row per person.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.dates import days_between, plus_days
from panelspark.functions.nulls import cap_below, strict_if
from panelspark.functions.recode import first_match
from panelspark.operators.keys import bind_rows
from panelspark.operators.panel import before, keep_through_first, person_order

CENSORED, FEW, MANY, DEAD = 0, 1, 2, 3


def cohort_inclusion(intervals: DataFrame, max_gap: int = 365, key="id", date="visdate") -> DataFrame:
    """Drop persons whose first interval is longer than ``max_gap`` days."""
    first_gap = F.first("gap_days").over(person_order(key, date))
    return (
        intervals.withColumn("_first_gap", first_gap)
        .filter(F.col("_first_gap") <= max_gap)
        .drop("_first_gap")
    )


def censor_gap(
    intervals: DataFrame, max_gap: int = 365, offset_days: int = 1, key="id", date="visdate"
) -> DataFrame:
    """End follow-up at the first interval longer than ``max_gap`` days.

    That interval stays as the person's last row, marked ``censor`` and dated
    ``offset_days`` after its start.
    """
    marked = intervals.withColumn("censor", (F.col("gap_days") > max_gap).cast("int"))
    kept = keep_through_first(marked, "censor", key, date)
    shifted = plus_days("visdate0", offset_days)
    return kept.withColumn(date, F.when(F.col("censor") == 1, shifted).otherwise(F.col(date)))


def append_deaths(
    followup: DataFrame,
    deaths: DataFrame,
    exclude_year: int | None = None,
    as_written: bool = False,
    key: str = "id",
) -> DataFrame:
    """Add a death row to cohort members and close their follow-up there.

    Deaths of persons outside ``followup`` or in ``exclude_year`` are left out,
    as is a death after censoring. The death interval starts at the person's
    last row before it; on a tied date the visit comes first. All rows after a
    death go; ``as_written`` drops only the row right after it.

    Membership is settled inside the person's own window, so ``followup`` is
    computed once, and both sides of the union are already placed by person.
    """
    died = deaths.select(key, F.col("dod").alias("visdate"), F.lit(1).alias("dead"))
    if exclude_year is not None:
        died = died.filter(F.year("visdate") != exclude_year)
    stacked = bind_rows(followup.withColumn("dead", F.lit(0)), died.repartition(key))
    member = F.min("dead").over(Window.partitionBy(key)) == 0
    stacked = stacked.withColumn("_member", member).filter("_member").drop("_member")
    w = person_order(key, ["visdate", "dead"])
    if as_written:
        closed = F.lag("censor", 1, 0).over(w)
    else:
        ended = F.greatest(F.coalesce("censor", F.lit(0)), F.col("dead"))
        closed = F.coalesce(F.max(ended).over(before(w)), F.lit(0))
    kept = stacked.withColumn("_closed", closed).filter(F.col("_closed") == 0).drop("_closed")
    died_now = F.col("dead") == 1
    return kept.withColumns(
        {
            "visdate0": F.when(died_now, F.lag("visdate").over(w)).otherwise(F.col("visdate0")),
            "censor": F.when(died_now, 0).otherwise(F.col("censor")),
        }
    )


def append_dropout(followup: DataFrame, end_year: int, key: str = "id") -> DataFrame:
    """Add a censor row the day after the last one of persons lost before ``end_year``.

    Lost means alive, not censored and last seen in an earlier year. The extra
    row is emitted next to the last row itself, so the table is neither read
    twice nor shuffled again.
    """
    w = person_order(key, ["visdate", "dead"])
    last = F.lead(F.lit(1)).over(w).isNull()
    lost = last & (F.col("censor") == 0) & (F.col("dead") == 0) & (F.year("visdate") < end_year)
    known = {
        "visdate0": F.col("visdate"),
        "visdate": plus_days("visdate", 1),
        "dead": F.lit(0),
        "censor": F.lit(1),
    }
    fields = [f for f in followup.schema if f.name != key]
    own = F.struct(*[F.col(f.name) for f in fields])
    extra = F.struct(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
    rows = F.when(F.col("_lost"), F.array(own, extra)).otherwise(F.array(own))
    out = followup.withColumn("_lost", lost).select(key, F.inline(rows))
    return out.select(*followup.columns)


def clock_intervals(
    followup: DataFrame, origin: dt.date, count: str = "n_cond", many: int = 2
) -> DataFrame:
    """Days since ``origin`` and the state a row ends in.

    Rows ending before ``origin`` go; an earlier start is moved up to it. States:
    0 censored, 1 fewer than ``many`` conditions, 2 the rest, 3 dead. A missing
    count falls into state 2.
    """
    day_zero = F.lit(origin)
    state = first_match(
        [
            (F.col("censor") == 1, CENSORED),
            (F.col("dead") == 1, DEAD),
            (F.col(count) < many, FEW),
        ],
        default=MANY,
    )
    out = followup.withColumns(
        {
            "days0": cap_below(days_between(day_zero, "visdate0"), 0),
            "days": days_between(day_zero, "visdate"),
            "state": state,
        }
    )
    return out.filter(F.col("days") >= 0)


def initial_state(clocked: DataFrame, key="id") -> DataFrame:
    """Add the state each interval starts in: the previous row's, else its own."""
    w = person_order(key, ["visdate", "dead"])
    return clocked.withColumn("state0", F.coalesce(F.lag("state").over(w), F.col("state")))


def followup_report(intervals: DataFrame, count: str = "n_cond", key: str = "id") -> DataFrame:
    """One row of counts of the rows that carry no or doubtful information."""
    uncounted = F.col(count).isNull() & F.col("state").isin(MANY)
    return intervals.agg(
        F.count("*").alias("n_rows"),
        F.sum(uncounted.cast("int")).alias("n_missing_count"),
        F.sum((F.col("days0") == F.col("days")).cast("int")).alias("n_zero_length"),
        F.sum(F.col("days0").isNull().cast("int")).alias("n_no_start"),
        F.sum((F.col("state0") == CENSORED).cast("int")).alias("n_start_censored"),
    )


def yearly_dropout(years: DataFrame, key="id", year: str = "yr", max_gap: int = 1) -> DataFrame:
    """Mark and re-date the first row after more than ``max_gap`` years unseen.

    ``drop`` is 1 on that row, whose year becomes the one after the last seen
    year; later rows of the person go. The first row of a person is never marked.
    """
    w = person_order(key, year)
    previous = F.lag(year).over(w)
    out = years.withColumns(
        {
            "_previous": previous,
            "drop": F.coalesce(F.col(year) - previous > max_gap, F.lit(False)).cast("int"),
        }
    )
    out = keep_through_first(out, "drop", key, year)
    moved = F.when(F.col("drop") == 1, F.col("_previous") + 1).otherwise(F.col(year))
    return out.withColumn(year, moved).drop("_previous")


def control_ratio(df: DataFrame, conditions: dict[str, str], count: str = "n_cond") -> DataFrame:
    """Share of conditions under control: ``{condition: uncontrolled flag}``.

    Adds ``n_control``, ``prop_control`` (NULL without conditions) and the flags
    ``all_control`` and ``most_control``.
    """
    terms = [F.col(c) * (1 - F.col(bad)) for c, bad in conditions.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    out = df.withColumn("n_control", total)
    share = F.try_divide(F.col("n_control").cast("double"), F.col(count).cast("double"))
    out = out.withColumn("prop_control", share)
    return out.withColumns(
        {
            "all_control": (F.col("prop_control") == 1).cast("int"),
            "most_control": (F.col("prop_control") > 0.5).cast("int"),
        }
    )


def control_state(df: DataFrame, count: str = "n_cond", many: int = 2) -> DataFrame:
    """State by drop-out, count and control; a NULL test gives a NULL state.

    0 dropped out, 1 few conditions, 2 many and all controlled, 3 many and not.
    """
    multi = F.col(count) >= many
    controlled = multi & (F.col("all_control") == 1)
    state = strict_if(
        F.col("drop") == 1,
        F.lit(0),
        strict_if(~multi, F.lit(1), strict_if(controlled, F.lit(2), F.lit(3))),
    )
    return df.withColumn("state", state)
