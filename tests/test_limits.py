"""Limits of the curve against derivatives by person weights, and against leaving persons out."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from checks import rows
from pyspark.sql import functions as F
from test_survival import SCHEMA, histories

from panelspark.operators import survival
from panelspark.operators.limits import occupancy_limits

STATES = (1, 2, 3)


def weighted_curve(data, weight, start_at="first_event"):
    """time -> shares, every interval counting as often as its person's weight says."""
    data = [r for r in data if r[1] < r[2]]
    times = sorted({r[2] for r in data})
    begins = [r[2] for r in data if r[4] != 0 and (start_at == "first_event" or r[4] != r[3])]
    first = min(begins, default=times[-1])
    at = [sum(weight[r[0]] for r in data if r[1] < first <= r[2] and r[3] == s) for s in STATES]
    p = np.array(at) / sum(at)
    out = {}
    for t in times:
        m = np.eye(3)
        for i, s in enumerate(STATES):
            risk = sum(weight[r[0]] for r in data if r[1] < t <= r[2] and r[3] == s)
            for j, to in enumerate(STATES):
                if to != s and risk:
                    moved = sum(weight[r[0]] for r in data if r[2] == t and r[3] == s and r[4] == to) / risk
                    m[i, j] += moved
                    m[i, i] -= moved
        p = p @ m
        out[t] = p
    return out


def errors(data, step, start_at="first_event"):
    """time -> standard errors: the curve's change per person's weight, squared and added up."""
    ids = sorted({r[0] for r in data})
    total = None
    for i in ids:
        up, down = (weighted_curve(data, {k: 1.0 + (k == i) * e for k in ids}, start_at) for e in step)
        part = {t: ((up[t] - down[t]) / (step[0] - step[1])) ** 2 for t in up if t in down}
        total = part if total is None else {t: total[t] + part[t] for t in part if t in total}
    return {t: np.sqrt(v) for t, v in total.items()}


@pytest.mark.parametrize("seed,start_at,more", [(3, "first_event", {}), (4, "first_transition", {"persons": 7}), (5, "first_event", {"persons": 11, "times": 5})])
def test_errors_are_derivatives_by_person(spark, seed, start_at, more):
    data = histories(seed, persons=40)
    # Somebody comes back after a gap.
    data += [(0, 300, 330, 2, 1), (1, 300, 310, 1, 0), (2, 305, 320, 1, 3)]
    got = occupancy_limits(spark.createDataFrame(data, SCHEMA), start_at=start_at, **more).collect()
    want, curve = errors(data, (1e-5, -1e-5), start_at), weighted_curve(data, dict.fromkeys(range(40), 1.0), start_at)
    assert {(r.time, r.state) for r in got} == {(t, s) for t in want for s in STATES}
    for r in got:
        assert abs(r.std_error - want[r.time][r.state - 1]) < 1e-7
        assert abs(r.estimate - curve[r.time][r.state - 1]) < 1e-12


def test_errors_are_near_those_of_leaving_persons_out(spark):
    data = histories(8, persons=90)
    left_out = errors(data, (0.0, -1.0))
    got = {(r.time, r.state): r.std_error for r in occupancy_limits(spark.createDataFrame(data, SCHEMA)).collect()}
    ratio = [got[t, s] / v[s - 1] for t, v in left_out.items() for s in STATES if t < 60 and v[s - 1] > 0.02]
    assert len(ratio) > 50 and abs(np.mean(ratio) - 1) < 0.1


def test_scales_and_levels(spark):
    df = spark.createDataFrame(histories(3, persons=30), SCHEMA)
    z = NormalDist().inv_cdf(0.95)
    for r in occupancy_limits(df, level=0.9).collect():
        if r.estimate > 0:
            spread = math.exp(z * r.std_error / r.estimate)
            assert abs(r.low - r.estimate / spread) < 1e-12 and abs(r.high - min(1.0, r.estimate * spread)) < 1e-12
        else:
            assert r.low is None and r.high is None
    for r in occupancy_limits(df, level=0.9, scale="plain").collect():
        assert abs(r.high - r.low - 2 * z * r.std_error) < 1e-12


def test_unused_rows_and_nothing(spark):
    data = histories(3, persons=20)
    plain = rows(occupancy_limits(spark.createDataFrame(data, SCHEMA), decimals=9))
    extra = [(50, 5, 5, 1, 2), (51, 9, 7, 1, 1), (52, 1, 9, 7, 1), (53, 1, 9, 1, None), (54, None, 9, 1, 1)]
    both = spark.createDataFrame(data + extra, SCHEMA).withColumns({c: F.lit("x") for c in ("grp", "u", "a", "b")})
    assert rows(occupancy_limits(both, decimals=9)) == plain
    assert occupancy_limits(spark.createDataFrame([], SCHEMA)).collect() == []
    # Rows without a key are one person.
    nobody = [(None, *r[1:]) if r[0] == 4 else r for r in data]
    assert rows(occupancy_limits(spark.createDataFrame(nobody, SCHEMA), decimals=9)) == plain


def test_estimates_are_the_curve(spark):
    df = spark.createDataFrame(histories(4), SCHEMA)
    curve = survival.state_occupancy(df, decimals=9).select("time", "state", "estimate")
    assert rows(occupancy_limits(df, decimals=9).select("time", "state", "estimate")) == rows(curve)
