"""Visits with condition counts and deaths -> follow-up intervals and state curves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import cohort, survival
from panelspark.operators.keys import last_per_key
from panelspark.operators.panel import intervals

# Clock origin, year without complete death records, last study
# year, longest gap between visits in days.
ORIGIN = dt.date(2008, 1, 1)
OPEN_DEATH_YEAR = 2020
END_YEAR = 2019
MAX_GAP = 365

# Conditions of the yearly variant and the measure that shows them
# out of control.
CONTROL = {
    "hypertension": "hi_bp",
    "diabetes": "hi_hba1c",
    "lung_disease": "poor_lung_func",
    "renal_disease": "renal_dysfunc",
}
YEARLY_START = -1


def follow_up(visits: DataFrame, mort: DataFrame, as_written: bool = False) -> DataFrame:
    """Counting-process intervals with start and end state."""
    followed = cohort.censor_gap(cohort.cohort_inclusion(intervals(visits), MAX_GAP), MAX_GAP)
    followed = followed.drop("gap_days", "n_vis")
    followed = cohort.append_deaths(followed, mort, OPEN_DEATH_YEAR, as_written)
    followed = cohort.append_dropout(followed, END_YEAR)
    return cohort.initial_state(cohort.clock_intervals(followed, ORIGIN))


def state_curve(intervals_: DataFrame) -> DataFrame:
    """Share of persons per state and date: few conditions, many, dead."""
    return survival.state_occupancy(intervals_, origin=ORIGIN)


def stacked_curve(curve: DataFrame) -> DataFrame:
    """One row per date with the shares and their running totals."""
    return survival.curve_wide(curve, time="date")


def yearly_states(visits: DataFrame) -> DataFrame:
    """Person-years with drop-out, disease control and state.

    A person-year is the last visit in it.
    """
    rows = visits.withColumn("yr", F.year("visdate"))
    yearly = cohort.yearly_dropout(last_per_key(rows, ["id", "yr"], "visdate"))
    return cohort.control_state(cohort.control_ratio(yearly, CONTROL))


def yearly_curve(person_years: DataFrame) -> DataFrame:
    """Shares by year: censored apart, few conditions, many controlled, many not."""
    rows = person_years.select(
        (F.col("yr") - 1).alias("days0"),
        F.col("yr").alias("days"),
        F.lit(YEARLY_START).alias("state0"),
        "state",
    )
    return survival.state_occupancy(rows, states=(YEARLY_START, 1, 2, 3))
