"""Queries from visits to multi-state curves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.catalog.book import query, step
from panelspark.catalog.measures import counted
from panelspark.operators import cohort, limits, panel, survival
from panelspark.operators.keys import drop_keys, keep_keys
from panelspark.sources import views

ORIGIN = dt.date(1996, 1, 1)
END_YEAR = 2001

step(
    "gaps",
    """
SELECT *, CAST(date_diff('day', visdate0, visdate) AS INT) AS gap_days
FROM (SELECT id, visit, visdate, n_cond, lag(visdate) OVER (PARTITION BY id ORDER BY visdate) AS visdate0
      FROM counted)
WHERE visdate0 IS NOT NULL""",
    "counted",
)
step(
    "included",
    """
SELECT * FROM gaps WHERE id NOT IN (
  SELECT id FROM (SELECT id, gap_days, row_number() OVER (PARTITION BY id ORDER BY visdate) AS rn FROM gaps)
  WHERE rn = 1 AND gap_days > 365)""",
    "gaps",
)
step(
    "censored",
    """
SELECT id, visit, n_cond, visdate0, censor,
       CASE WHEN censor = 1 THEN visdate0 + 1 ELSE visdate END AS visdate
FROM (SELECT *, sum(censors) OVER (PARTITION BY id ORDER BY visdate) AS dropped
      FROM (SELECT *, CAST(gap_days > 365 AS INT) AS censor,
                   sum(CAST(gap_days > 365 AS INT)) OVER (PARTITION BY id ORDER BY visdate) AS censors
            FROM included))
WHERE dropped < 2""",
    "included",
)
step(
    "stacked",
    """
SELECT id, visit, n_cond, visdate0, censor, visdate, 0 AS dead FROM censored
UNION ALL
SELECT id, NULL, NULL, NULL, NULL, dod, 1 FROM deaths
WHERE year(dod) <> 2001 AND id IN (SELECT id FROM censored)""",
    "censored",
    "deaths",
)
step(
    "closed",
    """
SELECT id, visit, n_cond, visdate, dead,
       CASE WHEN dead = 1 THEN previous ELSE visdate0 END AS visdate0,
       CASE WHEN dead = 1 THEN 0 ELSE censor END AS censor
FROM (SELECT *, lag(visdate) OVER (PARTITION BY id ORDER BY visdate, dead) AS previous,
             max(greatest(coalesce(censor, 0), dead)) OVER (
               PARTITION BY id ORDER BY visdate, dead
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
      FROM stacked)
WHERE coalesce(ended, 0) = 0""",
    "stacked",
)
step(
    "followed",
    """
SELECT id, visit, n_cond, visdate0, visdate, dead, censor FROM closed
UNION ALL
SELECT id, NULL, NULL, visdate, visdate + 1, 0, 1
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY visdate DESC, dead DESC) AS rn FROM closed)
WHERE rn = 1 AND censor = 0 AND dead = 0 AND year(visdate) < 2001""",
    "closed",
)
step(
    "clocked",
    """
SELECT *, CASE WHEN censor = 1 THEN 0 WHEN dead = 1 THEN 3 WHEN n_cond < 2 THEN 1 ELSE 2 END AS state
FROM (SELECT *, CAST(date_diff('day', DATE '1996-01-01', visdate) AS INT) AS days,
             CASE WHEN visdate0 < DATE '1996-01-01' THEN 0
                  ELSE CAST(date_diff('day', DATE '1996-01-01', visdate0) AS INT) END AS days0
      FROM followed)
WHERE days >= 0""",
    "followed",
)
step(
    "chained",
    """
SELECT *, coalesce(lag(state) OVER (PARTITION BY id ORDER BY visdate, dead), state) AS state0
FROM clocked""",
    "clocked",
)
step("usable", "SELECT * FROM chained WHERE days0 < days AND state0 IN (1, 2, 3)", "chained")
step(
    "at_risk",
    """
SELECT t.time, s.state, CAST(count(u.id) AS BIGINT) AS n_risk
FROM (SELECT DISTINCT days AS time FROM usable) t
CROSS JOIN (VALUES (1), (2), (3)) s(state)
LEFT JOIN usable u ON u.days0 < t.time AND t.time <= u.days AND u.state0 = s.state
GROUP BY 1, 2""",
    "usable",
)
step(
    "moves",
    """
SELECT days AS time, state0, state, count(*) AS n FROM usable
WHERE state <> 0 AND state <> state0 GROUP BY 1, 2, 3""",
    "usable",
)
step(
    "hazards",
    """
SELECT row_number() OVER (ORDER BY time) AS k, * FROM (
  SELECT r.time, n1, n2, n3,
         coalesce(e12, 0) / greatest(n1, 1)::DOUBLE AS h12, coalesce(e13, 0) / greatest(n1, 1)::DOUBLE AS h13,
         coalesce(e21, 0) / greatest(n2, 1)::DOUBLE AS h21, coalesce(e23, 0) / greatest(n2, 1)::DOUBLE AS h23,
         coalesce(e31, 0) / greatest(n3, 1)::DOUBLE AS h31, coalesce(e32, 0) / greatest(n3, 1)::DOUBLE AS h32
  FROM (SELECT time, sum(n_risk) FILTER (WHERE state = 1) AS n1, sum(n_risk) FILTER (WHERE state = 2) AS n2,
               sum(n_risk) FILTER (WHERE state = 3) AS n3 FROM at_risk GROUP BY time) r
  LEFT JOIN (SELECT time, sum(n) FILTER (WHERE state0 = 1 AND state = 2) AS e12,
                    sum(n) FILTER (WHERE state0 = 1 AND state = 3) AS e13,
                    sum(n) FILTER (WHERE state0 = 2 AND state = 1) AS e21,
                    sum(n) FILTER (WHERE state0 = 2 AND state = 3) AS e23,
                    sum(n) FILTER (WHERE state0 = 3 AND state = 1) AS e31,
                    sum(n) FILTER (WHERE state0 = 3 AND state = 2) AS e32
             FROM moves GROUP BY time) m ON m.time = r.time)""",
    "at_risk",
    "moves",
)
step(
    "shares",
    """
SELECT CAST(0 AS BIGINT) AS k, n1 / (n1 + n2 + n3)::DOUBLE AS p1, n2 / (n1 + n2 + n3)::DOUBLE AS p2,
       n3 / (n1 + n2 + n3)::DOUBLE AS p3
FROM hazards WHERE time = (SELECT min(days) FROM usable WHERE state <> 0)
UNION ALL
SELECT h.k, p1 + p2 * h21 + p3 * h31 - p1 * (h12 + h13),
       p2 + p1 * h12 + p3 * h32 - p2 * (h21 + h23),
       p3 + p1 * h13 + p2 * h23 - p3 * (h31 + h32)
FROM shares s JOIN hazards h ON h.k = s.k + 1""",
    "hazards",
)
step(
    "occupancy",
    """
SELECT r.time, DATE '1996-01-01' + r.time AS date, r.state, r.n_risk,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_event,
       round(CASE r.state WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 6) AS estimate
FROM at_risk r
JOIN hazards h ON h.time = r.time JOIN shares s ON s.k = h.k
LEFT JOIN (SELECT time, state, sum(n) AS n FROM moves GROUP BY 1, 2) m
ON m.time = r.time AND m.state = r.state""",
    "at_risk",
    "moves",
    "hazards",
    "shares",
)


def gaps(spark, sf_dir):
    rows = counted(spark, sf_dir).select("id", "visit", "visdate", "n_cond")
    return panel.intervals(rows)


def censored(spark, sf_dir):
    return cohort.censor_gap(cohort.cohort_inclusion(gaps(spark, sf_dir))).drop("gap_days")


def closed(spark, sf_dir):
    return cohort.append_deaths(censored(spark, sf_dir), views.deaths(spark, sf_dir), exclude_year=2001)


def followed(spark, sf_dir):
    return cohort.append_dropout(closed(spark, sf_dir), END_YEAR)


def chained(spark, sf_dir):
    return cohort.initial_state(cohort.clock_intervals(followed(spark, sf_dir), ORIGIN))


@query("cohort_inclusion", "SELECT id, visit, visdate0, visdate, gap_days, n_cond FROM included", "included")
def cohort_inclusion(spark, sf_dir):
    return cohort.cohort_inclusion(gaps(spark, sf_dir))


@query("censor_gap", "SELECT * FROM censored", "censored")
def censor_gap(spark, sf_dir):
    return censored(spark, sf_dir)


@query(
    "deaths_in_cohort",
    "SELECT id, dod FROM deaths WHERE year(dod) <> 2001 AND id IN (SELECT id FROM censored)",
    "deaths",
    "censored",
)
def deaths_in_cohort(spark, sf_dir):
    died = views.deaths(spark, sf_dir).filter(F.year("dod") != 2001)
    return keep_keys(died, censored(spark, sf_dir), "id")


@query(
    "deaths_outside_cohort",
    "SELECT id, dod FROM deaths WHERE id NOT IN (SELECT id FROM censored)",
    "deaths",
    "censored",
)
def deaths_outside_cohort(spark, sf_dir):
    return drop_keys(views.deaths(spark, sf_dir), censored(spark, sf_dir), "id")


@query(
    "append_deaths_as_written",
    """
SELECT id, visit, n_cond, visdate, dead,
       CASE WHEN dead = 1 THEN lag(visdate) OVER (PARTITION BY id ORDER BY visdate, dead) ELSE visdate0 END AS visdate0,
       CASE WHEN dead = 1 THEN 0 ELSE censor END AS censor
FROM (SELECT *, lag(censor, 1, 0) OVER (PARTITION BY id ORDER BY visdate, dead) AS before FROM stacked)
WHERE before = 0""",
    "stacked",
)
def append_deaths_as_written(spark, sf_dir):
    """Only the row right after a death or censoring goes."""
    return cohort.append_deaths(
        censored(spark, sf_dir), views.deaths(spark, sf_dir), exclude_year=2001, as_written=True
    )


@query("append_deaths", "SELECT * FROM closed", "closed")
def append_deaths(spark, sf_dir):
    return closed(spark, sf_dir)


@query("append_dropout", "SELECT * FROM followed", "followed")
def append_dropout(spark, sf_dir):
    return followed(spark, sf_dir)


@query("clock_intervals", "SELECT * FROM clocked", "clocked")
def clock_intervals(spark, sf_dir):
    return cohort.clock_intervals(followed(spark, sf_dir), ORIGIN)


@query("initial_state", "SELECT * FROM chained", "chained")
def initial_state(spark, sf_dir):
    return chained(spark, sf_dir)


@query(
    "followup_report",
    """
SELECT count(*) AS n_rows,
       CAST(count(*) FILTER (WHERE n_cond IS NULL AND state = 2) AS BIGINT) AS n_missing_count,
       CAST(count(*) FILTER (WHERE days0 = days) AS BIGINT) AS n_zero_length,
       CAST(count(*) FILTER (WHERE days0 IS NULL) AS BIGINT) AS n_no_start,
       CAST(count(*) FILTER (WHERE state0 = 0) AS BIGINT) AS n_start_censored
FROM chained""",
    "chained",
)
def followup_report(spark, sf_dir):
    return cohort.followup_report(chained(spark, sf_dir))


@query("risk_sets", "SELECT time, state, n_risk FROM at_risk", "at_risk")
def risk_sets(spark, sf_dir):
    return survival.risk_sets(chained(spark, sf_dir))


@query("transition_counts", "SELECT time, state0, state, n FROM moves", "moves")
def transition_counts(spark, sf_dir):
    return survival.transition_counts(chained(spark, sf_dir))


@query("state_occupancy", "SELECT * FROM occupancy", "occupancy")
def state_occupancy(spark, sf_dir):
    return survival.state_occupancy(chained(spark, sf_dir), origin=ORIGIN, decimals=6)


@query(
    "state_curve_wide",
    """
SELECT date, round(risk1, 6) AS risk1, round(risk2, 6) AS risk2, round(risk3, 6) AS risk3,
       round(risk1, 6) AS no_multi, round(risk1 + risk2, 6) AS multi, round(risk1 + risk2 + risk3, 6) AS death
FROM (SELECT DATE '1996-01-01' + h.time AS date, p1 AS risk1, p2 AS risk2, p3 AS risk3
      FROM hazards h JOIN shares s ON s.k = h.k)""",
    "hazards",
    "shares",
)
def state_curve_wide(spark, sf_dir):
    wide = survival.occupancy_wide(chained(spark, sf_dir), origin=ORIGIN)
    return wide.select("date", *[F.round(c, 6).alias(c) for c in wide.columns if c != "date"])


@query("state_limits")
def state_limits(spark, sf_dir):
    """The curve with its standard errors and 95 % limits."""
    return limits.occupancy_limits(chained(spark, sf_dir), origin=ORIGIN, decimals=6)
