"""Queries of the yearly variant: drop-out, disease control, yearly curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.book import query, step
from panelspark.catalog.measures import counted, elevated
from panelspark.operators import cohort, survival
from panelspark.operators.keys import last_per_key
from panelspark.sources import views

step("person_years", "SELECT DISTINCT id, CAST(year(visdate) AS INT) AS yr FROM visits", "visits")


def _dropped(source: str) -> str:
    return f"""
SELECT * EXCLUDE (yr, previous, earlier), CASE WHEN "drop" = 1 THEN previous + 1 ELSE yr END AS yr
FROM (SELECT *, coalesce(sum("drop") OVER (PARTITION BY id ORDER BY yr
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM (SELECT *, lag(yr) OVER (PARTITION BY id ORDER BY yr) AS previous,
                   CASE WHEN yr - lag(yr) OVER (PARTITION BY id ORDER BY yr) > 1 THEN 1 ELSE 0 END AS "drop"
            FROM {source}))
WHERE earlier = 0"""


step("dropped_years", _dropped("person_years"), "person_years")
step(
    "year_rows",
    """
SELECT * EXCLUDE (rn), cond_a + cond_b + cond_c AS n_cond
FROM (SELECT id, CAST(year(visdate) AS INT) AS yr, cond_a, cond_b, cond_c,
             CAST(lab1 > 250000 AS INT) AS hi_a, CAST(lab2 > 600000 AS INT) AS hi_b,
             CAST(lab3 >= 40 AS INT) AS hi_c,
             row_number() OVER (PARTITION BY id, year(visdate) ORDER BY visdate DESC) AS rn
      FROM counted)
WHERE rn = 1""",
    "counted",
)
step("dropped_rows", _dropped("year_rows"), "year_rows")
step(
    "controlled",
    """
SELECT *, CAST(prop_control = 1 AS INT) AS all_control, CAST(prop_control > 0.5 AS INT) AS most_control
FROM (SELECT *, CASE WHEN n_cond <> 0 THEN n_control / n_cond::DOUBLE END AS prop_control
      FROM (SELECT *, cond_a * (1 - hi_a) + cond_b * (1 - hi_b) + cond_c * (1 - hi_c) AS n_control
            FROM dropped_rows))""",
    "dropped_rows",
)
step(
    "year_states",
    """
SELECT *, CASE WHEN "drop" = 1 THEN 0
               WHEN n_cond < 2 THEN 1
               WHEN all_control = 1 THEN 2
               WHEN all_control = 0 THEN 3 END AS state
FROM controlled""",
    "controlled",
)
step(
    "year_hazards",
    """
SELECT row_number() OVER (ORDER BY yr) AS k, yr AS time, count(*) AS n,
       count(*) FILTER (WHERE state = 1) AS e1, count(*) FILTER (WHERE state = 2) AS e2,
       count(*) FILTER (WHERE state = 3) AS e3
FROM year_states WHERE state IS NOT NULL GROUP BY yr""",
    "year_states",
)
step(
    "year_shares",
    """
SELECT CAST(0 AS BIGINT) AS k, 1e0 AS p0, 0e0 AS p1, 0e0 AS p2, 0e0 AS p3
UNION ALL
SELECT h.k, p0 - p0 * (e1 + e2 + e3) / n::DOUBLE, p1 + p0 * e1 / n::DOUBLE,
       p2 + p0 * e2 / n::DOUBLE, p3 + p0 * e3 / n::DOUBLE
FROM year_shares s JOIN year_hazards h ON h.k = s.k + 1""",
    "year_hazards",
)


def year_rows(spark, sf_dir):
    """Last visit of each person and calendar year with conditions and cut-off flags."""
    last = last_per_key(
        counted(spark, sf_dir).withColumn("yr", F.year("visdate")), ["id", "yr"], "visdate"
    )
    high = elevated()
    return last.select(
        "id",
        "yr",
        "cond_a",
        "cond_b",
        "cond_c",
        high["lab1"].cast("int").alias("hi_a"),
        high["lab2"].cast("int").alias("hi_b"),
        high["lab3"].cast("int").alias("hi_c"),
        (F.col("cond_a") + F.col("cond_b") + F.col("cond_c")).alias("n_cond"),
    )


def controlled(spark, sf_dir):
    dropped = cohort.yearly_dropout(year_rows(spark, sf_dir))
    return cohort.control_ratio(dropped, {"cond_a": "hi_a", "cond_b": "hi_b", "cond_c": "hi_c"})


@query("yearly_dropout", 'SELECT id, yr, "drop" FROM dropped_years', "dropped_years")
def yearly_dropout(spark, sf_dir):
    # Years come straight from the raw rows: repeats collapse in the distinct.
    years = views.raw_visits(spark, sf_dir).select("id", F.year("visdate").alias("yr")).distinct()
    return cohort.yearly_dropout(years)


@query(
    "control_ratio",
    """
SELECT id, yr, "drop", n_cond, n_control, round(prop_control, 4) AS prop_control, all_control, most_control
FROM controlled""",
    "controlled",
)
def control_ratio(spark, sf_dir):
    return controlled(spark, sf_dir).select(
        "id",
        "yr",
        "drop",
        "n_cond",
        "n_control",
        F.round("prop_control", 4).alias("prop_control"),
        "all_control",
        "most_control",
    )


# Every row enters from one common start state, as if it were a person of its own.
START = -1


@query(
    "yearly_state_curve",
    """
SELECT h.time, v.state, CAST(CASE WHEN v.state = -1 THEN n ELSE 0 END AS BIGINT) AS n_risk,
       CASE v.state WHEN -1 THEN 0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS n_event,
       round(CASE v.state WHEN -1 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 6) AS estimate
FROM year_hazards h JOIN year_shares s ON s.k = h.k
CROSS JOIN (VALUES (-1), (1), (2), (3)) v(state)""",
    "year_hazards",
    "year_shares",
)
def yearly_state_curve(spark, sf_dir):
    states = cohort.control_state(controlled(spark, sf_dir))
    rows = states.select(
        (F.col("yr") - 1).alias("days0"), F.col("yr").alias("days"), F.lit(START).alias("state0"), "state"
    )
    return survival.state_occupancy(rows, states=(START, 1, 2, 3), decimals=6)
