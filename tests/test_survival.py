import datetime as dt
import random

import numpy as np
import pytest
from checks import rows
from pyspark.sql import functions as F

from panelspark.operators import survival

SCHEMA = "id int, days0 int, days int, state0 int, state int"


def histories(seed, persons=120, absorbing=3):
    """Random interval rows of persons moving between states 1, 2 and 3."""
    rng = random.Random(seed)
    out = []
    for person in range(persons):
        day, state = rng.randrange(30), rng.choice([1, 1, 2])
        for _ in range(rng.randrange(1, 6)):
            end = day + rng.randrange(1, 40)
            to = rng.choice([0, 1, 1, 2, 2, 3])
            out.append((person, day, end, state, to))
            if to in (0, absorbing):
                break
            day, state = end, to
    return out


def aalen_johansen(data, states=(1, 2, 3)):
    """Shares by time as a product of one transition matrix per time."""
    k = len(states)
    data = [r for r in data if r[1] < r[2]]
    times = sorted({r[2] for r in data})
    first = min(r[2] for r in data if r[4] != 0)
    at = [r[3] for r in data if r[1] < first <= r[2]]
    p = np.array([at.count(s) / len(at) for s in states])
    out = {}
    for t in times:
        m = np.eye(k)
        for i, s in enumerate(states):
            risk = sum(1 for r in data if r[1] < t <= r[2] and r[3] == s)
            for j, to in enumerate(states):
                if to != s and risk:
                    moved = sum(1 for r in data if r[2] == t and r[3] == s and r[4] == to) / risk
                    m[i, j] += moved
                    m[i, i] -= moved
        p = p @ m
        out[t] = p
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_curve_equals_matrix_product(spark, seed):
    data = histories(seed)
    curve = survival.state_occupancy(spark.createDataFrame(data, SCHEMA))
    got = {(r["time"], r["state"]): r["estimate"] for r in curve.collect()}
    want = {(t, s): p[i] for t, p in aalen_johansen(data).items() for i, s in enumerate((1, 2, 3))}
    assert got.keys() == want.keys()
    assert max(abs(got[c] - want[c]) for c in want) < 1e-12


def test_shares_sum_to_one_and_death_never_falls(spark):
    curve = survival.state_occupancy(spark.createDataFrame(histories(6), SCHEMA), origin=dt.date(2008, 1, 1))
    wide = survival.curve_wide(curve, time="date").orderBy("date").collect()
    assert all(abs(r["death"] - 1) < 1e-9 for r in wide)
    dead = [r["risk3"] for r in wide]
    assert all(b >= a - 1e-12 for a, b in zip(dead, dead[1:])) and dead[-1] > 0


def test_risk_sets_count_open_intervals(spark):
    data = histories(7)
    got = rows(survival.risk_sets(spark.createDataFrame(data, SCHEMA)), "time", "state", "n_risk")
    want = sorted(
        (t, s, sum(1 for r in data if r[1] < t <= r[2] and r[3] == s))
        for t in {r[2] for r in data} for s in (1, 2, 3)
    )
    assert got == want


def test_transitions(spark):
    data = [(1, 0, 5, 1, 1), (1, 5, 9, 1, 2), (2, 0, 9, 1, 2), (3, 0, 9, 2, 0), (4, 9, 9, 1, 3)]
    assert rows(survival.transition_counts(spark.createDataFrame(data, SCHEMA))) == [(9, 1, 2, 2)]


def test_state_one_is_no_censoring_when_nobody_is_censored(spark):
    data = [(1, 0, 5, 1, 2), (2, 0, 6, 2, 1)]
    curve = survival.state_occupancy(spark.createDataFrame(data, SCHEMA))
    assert rows(curve, "time", "state", "n_event") == [(5, 1, 0), (5, 2, 1), (5, 3, 0), (6, 1, 1), (6, 2, 0), (6, 3, 0)]


def test_start_of_the_curve(spark):
    # Person 3 leaves, censored, before anything is seen; person 4 moves first.
    data = [(1, 0, 10, 1, 1), (2, 0, 10, 2, 2), (3, 0, 4, 3, 0), (4, 2, 20, 2, 1), (5, 12, 30, 2, 2)]
    df = spark.createDataFrame(data, SCHEMA)

    def first(how):
        out = survival.state_occupancy(df, start_at=how).filter("time = 4").orderBy("state")
        return [r["estimate"] for r in out.collect()]

    assert first("first_event") == pytest.approx([1 / 3, 2 / 3, 0])
    assert first("first_transition") == pytest.approx([0, 1, 0])


def test_nothing_ever_happens(spark):
    curve = survival.state_occupancy(spark.createDataFrame([(1, 0, 5, 1, 0), (2, 0, 7, 2, 0)], SCHEMA))
    assert rows(curve.filter("time = 7"), "state", "estimate") == [(1, 0.0), (2, 1.0), (3, 0.0)]


def test_groups_have_their_own_curves(spark):
    a, b = histories(8), histories(9)
    df = spark.createDataFrame(a, SCHEMA).withColumn("g", F.lit("a")).unionByName(
        spark.createDataFrame(b, SCHEMA).withColumn("g", F.lit("b"))
    )
    both = survival.state_occupancy(df, by=["g"], decimals=9)
    alone = survival.state_occupancy(spark.createDataFrame(b, SCHEMA), decimals=9)
    assert rows(both.filter("g = 'b'").drop("g")) == rows(alone)


def test_rows_without_a_known_end_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, 5, 1, 2), (2, 0, 5, 1, None)], SCHEMA)
    assert rows(survival.risk_sets(df)) == [(5, 1, 1), (5, 2, 0), (5, 3, 0)]


def test_totals_of_every_state(spark):
    curve = spark.createDataFrame([(1, i, 0.25) for i in (0, 1, 2, 3)], "time int, state int, estimate double")
    row = survival.curve_wide(curve, states=(0, 1, 2, 3)).first()
    assert [row[f"upto{i}"] for i in (0, 1, 2, 3)] == [0.25, 0.5, 0.75, 1.0]
