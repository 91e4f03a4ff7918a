import datetime as dt
import random

import pytest
from checks import rows
from pyspark.sql import functions as F

from panelspark.operators import cohort, panel

D = dt.date
SCHEMA = "id int, visdate date, n_cond int"
ORIGIN = D(2008, 1, 1)


def follow(spark, visits, deaths=(), as_written=False):
    gaps = panel.intervals(spark.createDataFrame(visits, SCHEMA))
    kept = cohort.censor_gap(cohort.cohort_inclusion(gaps)).drop("gap_days")
    died = spark.createDataFrame(list(deaths), "id int, dod date")
    return cohort.append_deaths(kept, died, exclude_year=2020, as_written=as_written)


def chain(spark, visits, deaths=(), as_written=False):
    followed = cohort.append_dropout(follow(spark, visits, deaths, as_written), 2019)
    return cohort.initial_state(cohort.clock_intervals(followed, ORIGIN))


def spans(df):
    return rows(df, "id", "visdate0", "visdate", "censor", "dead")


def test_long_gap_ends_follow_up_one_day_after_the_last_visit(spark):
    visits = [(1, D(2008, 3, 1), 0), (1, D(2008, 9, 1), 0), (1, D(2010, 1, 10), 0), (1, D(2010, 6, 1), 0)]
    assert spans(follow(spark, visits, [(1, D(2011, 2, 2))])) == [
        (1, D(2008, 3, 1), D(2008, 9, 1), 0, 0),
        (1, D(2008, 9, 1), D(2008, 9, 2), 1, 0),
    ]


def test_persons_whose_first_gap_is_long_are_out(spark):
    visits = [(1, D(2008, 1, 1), 0), (1, D(2009, 6, 1), 0), (1, D(2009, 9, 1), 0),
              (2, D(2008, 1, 1), 0), (2, D(2008, 12, 31), 0)]
    assert {r[0] for r in spans(follow(spark, visits))} == {2}


def test_death_on_a_visit_day_comes_after_the_visit(spark):
    visits = [(1, D(2008, 1, 1), 0), (1, D(2008, 6, 1), 0)]
    out = chain(spark, visits, [(1, D(2008, 6, 1))])
    assert spans(out) == [
        (1, D(2008, 1, 1), D(2008, 6, 1), 0, 0),
        (1, D(2008, 6, 1), D(2008, 6, 1), 0, 1),
    ]
    assert cohort.followup_report(out).first()["n_zero_length"] == 1


def test_visits_after_a_death(spark):
    visits = [(1, D(2008, 1, 1), 0), (1, D(2008, 6, 1), 0), (1, D(2008, 9, 1), 0), (1, D(2008, 12, 1), 0)]
    death = [(1, D(2008, 7, 1))]
    assert [r[2] for r in spans(follow(spark, visits, death))] == [D(2008, 6, 1), D(2008, 7, 1)]
    as_written = spans(follow(spark, visits, death, as_written=True))
    assert [r[2] for r in as_written] == [D(2008, 6, 1), D(2008, 7, 1), D(2008, 12, 1)]


def test_deaths_outside_the_cohort_or_in_the_open_year(spark):
    visits = [(1, D(2018, 1, 1), 0), (1, D(2018, 6, 1), 0)]
    out = follow(spark, visits, [(1, D(2020, 2, 1)), (2, D(2018, 2, 1))])
    assert {(r[0], r[4]) for r in spans(out)} == {(1, 0)}


def test_lost_persons_get_a_censor_row(spark):
    visits = [(1, D(2018, 1, 1), 3), (1, D(2018, 6, 1), 3), (2, D(2018, 9, 1), 3), (2, D(2019, 3, 1), 3)]
    out = chain(spark, visits)
    assert rows(out, "id", "visdate0", "visdate", "censor", "n_cond", "state0", "state") == [
        (1, D(2018, 1, 1), D(2018, 6, 1), 0, 3, 2, 2),
        (1, D(2018, 6, 1), D(2018, 6, 2), 1, None, 2, 0),
        (2, D(2018, 9, 1), D(2019, 3, 1), 0, 3, 2, 2),
    ]


def test_clock_clamps_early_starts_and_drops_early_ends(spark):
    visits = [(1, D(2007, 6, 1), 0), (1, D(2007, 9, 1), 0), (1, D(2008, 3, 1), 0), (1, D(2008, 6, 1), None)]
    out = chain(spark, visits)
    assert rows(out, "days0", "days", "state0", "state")[:2] == [(0, 60, 1, 1), (60, 152, 1, 2)]
    assert cohort.followup_report(out).first()["n_missing_count"] == 1


def brute_force(visits, deaths):
    """The whole chain for one person after the other, row by row."""
    out = []
    by_person = {}
    for person, day, n in sorted(visits):
        by_person.setdefault(person, []).append((day, n))
    for person, seen in by_person.items():
        spans = [(a[0], b[0], b[1]) for a, b in zip(seen, seen[1:])]
        if not spans or (spans[0][1] - spans[0][0]).days > 365:
            continue
        kept = []
        for start, end, n in spans:
            if (end - start).days > 365:
                kept.append([start, start + dt.timedelta(days=1), n, 1, 0])
                break
            kept.append([start, end, n, 0, 0])
        dod = deaths.get(person)
        if dod and dod.year != 2020:
            before = [k for k in kept if k[1] <= dod]
            if not (before and before[-1][3]):
                kept = [*before, [before[-1][1] if before else None, dod, None, 0, 1]]
        last = kept[-1]
        if not last[3] and not last[4] and last[1].year < 2019:
            kept.append([last[1], last[1] + dt.timedelta(days=1), None, 1, 0])
        state0 = None
        for start, end, n, censor, dead in kept:
            if end < ORIGIN:
                continue
            state = 0 if censor else 3 if dead else 1 if n is not None and n < 2 else 2
            days0 = None if start is None else max((start - ORIGIN).days, 0)
            out.append((person, days0, (end - ORIGIN).days, state if state0 is None else state0, state))
            state0 = state
    return sorted(out, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    visits, deaths = [], {}
    for person in range(80):
        day = D(2006, 1, 1) + dt.timedelta(days=rng.randrange(900))
        for _ in range(rng.randrange(1, 14)):
            visits.append((person, day, rng.choice([None, 0, 1, 2, 3])))
            day += dt.timedelta(days=rng.choice([30, 180, 200, 364, 365, 366, 500]))
        if rng.random() < 0.4:
            deaths[person] = D(2006, 6, 1) + dt.timedelta(days=rng.randrange(5200))
    out = chain(spark, visits, list(deaths.items()))
    assert rows(out, "id", "days0", "days", "state0", "state") == brute_force(visits, deaths)


def test_yearly_dropout(spark):
    years = [(1, 2007), (1, 2008), (1, 2011), (1, 2012), (2, 2009)]
    out = cohort.yearly_dropout(spark.createDataFrame(years, "id int, yr int"))
    assert rows(out, "id", "yr", "drop") == [(1, 2007, 0), (1, 2008, 0), (1, 2009, 1), (2, 2009, 0)]


def test_control(spark):
    df = spark.createDataFrame(
        [(1, 0, 1, 0, 0, 0, 1), (2, 1, 1, 0, 0, 2, 0), (3, 1, 1, 1, 0, 2, 0), (4, 1, 1, 0, None, 2, 0)],
        "id int, a int, b int, bad_a int, bad_b int, n_cond int, drop int",
    )
    out = cohort.control_state(cohort.control_ratio(df, {"a": "bad_a", "b": "bad_b"}))
    assert rows(out, "id", "prop_control", "all_control", "most_control", "state") == [
        (1, None, None, None, 0), (2, 1.0, 1, 1, 2), (3, 0.5, 0, 0, 3), (4, None, None, None, None),
    ]
