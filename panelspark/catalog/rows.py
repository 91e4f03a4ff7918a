"""Queries that work row by row on the visit, person and death tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.book import query
from panelspark.functions import (
    any_equal,
    as_flag,
    cap_above,
    keep_levels,
    parse_ymd,
    right_closed_bins,
    strict_if,
)
from panelspark.operators.keys import bind_rows, join_on, over_columns
from panelspark.plans.intake import DOMAINS, PERIOD_BREAKS, PERIODS, domain_table, enriched_visits
from panelspark.sources import views
from panelspark.sources.tables import RAW_SCHEMAS

@query(
    "period_bins",
    """
SELECT id, yr_enroll,
       CASE WHEN yr_enroll > 1987 AND yr_enroll <= 1992 THEN '1988-1992'
            WHEN yr_enroll > 1992 AND yr_enroll <= 1997 THEN '1994-1997'
            WHEN yr_enroll > 1997 AND yr_enroll <= 2001 THEN '1998-2001'
            WHEN yr_enroll > 2001 AND yr_enroll <= 2015 THEN '2005-2015'
            WHEN yr_enroll > 2015 AND yr_enroll <= 2018 THEN '2016-2018' END AS period
FROM subjects""",
    "subjects",
)
def period_bins(spark, sf_dir):
    return views.subjects(spark, sf_dir).select(
        "id",
        "yr_enroll",
        right_closed_bins("yr_enroll", PERIOD_BREAKS, PERIODS).alias("period"),
    )


@query(
    "year_window",
    "SELECT * FROM visits WHERE year(visdate) BETWEEN 1996 AND 1999",
    "visits",
)
def year_window(spark, sf_dir):
    return views.visits(spark, sf_dir, years=(1996, 1999))


@query(
    "strict_ifelse",
    """
SELECT id, visit, visdate, grp01,
       CASE WHEN grp01 = 1 THEN lab1 WHEN grp01 <> 1 THEN lab2 END AS chosen
FROM visits LEFT JOIN subjects USING (id)""",
    "visits",
    "subjects",
)
def strict_ifelse(spark, sf_dir):
    persons = views.subjects(spark, sf_dir).select("id", "grp01")
    rows = join_on(views.visits(spark, sf_dir), persons, "id")
    chosen = strict_if(F.col("grp01") == 1, F.col("lab1"), F.col("lab2"))
    return rows.select("id", "visit", "visdate", "grp01", chosen.alias("chosen"))


@query(
    "any_treatment_flag",
    """
SELECT id, visit, dx, tx, used,
       CAST((tx = 1) OR (dx = 1) OR (used = 1) AS INT) AS any_treatment
FROM visits""",
    "visits",
)
def any_treatment_flag(spark, sf_dir):
    either = (F.col("tx") == 1) | (F.col("dx") == 1) | (F.col("used") == 1)
    return views.visits(spark, sf_dir).select(
        "id", "visit", "dx", "tx", "used", as_flag(either).alias("any_treatment")
    )


@query(
    "any_use_flag",
    """
SELECT id, visit, dx, tx, used,
       CASE WHEN dx = 1 OR tx = 1 OR used = 1 THEN 1 ELSE 0 END AS any_use
FROM visits""",
    "visits",
)
def any_use_flag(spark, sf_dir):
    return views.visits(spark, sf_dir).select(
        "id", "visit", "dx", "tx", "used", as_flag(any_equal(["dx", "tx", "used"], 1)).alias("any_use")
    )


@query(
    "mortality",
    "SELECT id, dod, CAST(year(dod) AS INT) AS yod FROM deaths",
    "deaths",
)
def mortality(spark, sf_dir):
    notices = views.death_notices(spark, sf_dir).filter(F.col("dead") == 1)
    dated = notices.withColumn("dod", parse_ymd("dod_text"))
    return dated.select("id", "dod", F.year("dod").alias("yod"))


@query(
    "domain_check",
    """
SELECT id, visit, lab3, CASE WHEN lab3 BETWEEN 0 AND 9 THEN lab3 END AS lab3_kept
FROM visits""",
    "visits",
)
def domain_check(spark, sf_dir):
    levels = [float(k) for k in range(10)]
    return views.visits(spark, sf_dir).select(
        "id", "visit", "lab3", keep_levels("lab3", levels).alias("lab3_kept")
    )


@query(
    "coalesce_flags",
    "SELECT id, visit, coalesce(dx, 0) AS dx, coalesce(used, 0) AS used FROM visits",
    "visits",
)
def coalesce_flags(spark, sf_dir):
    rows = views.visits(spark, sf_dir).select("id", "visit", "dx", "used")
    return over_columns(rows, ["dx", "used"], lambda c: F.coalesce(c, F.lit(0)))


@query(
    "ceil_score",
    "SELECT id, visit, lab3, CAST(ceil(lab3 / 7e0) AS DOUBLE) AS score FROM visits",
    "visits",
)
def ceil_score(spark, sf_dir):
    score = F.ceil(F.col("lab3") / F.lit(7.0)).cast("double")
    return views.visits(spark, sf_dir).select("id", "visit", "lab3", score.alias("score"))


@query(
    "split_cap_union",
    """
SELECT id, visit, visdate,
       CASE WHEN year(visdate) < 1998 AND lab1 > 250000 THEN 250000e0 ELSE lab1 END AS lab1,
       CASE WHEN year(visdate) < 1998 THEN 'early' ELSE 'late' END AS part
FROM visits""",
    "visits",
)
def split_cap_union(spark, sf_dir):
    # Two parts by year, each treated on its own, then stacked again. Every row is in one
    # of them: what is not known to be early is late.
    rows = views.visits(spark, sf_dir).select("id", "visit", "visdate", "lab1")
    is_early = F.coalesce(F.col("visdate") < F.lit("1998-01-01").cast("date"), F.lit(False))
    early, late = rows.filter(is_early), rows.filter(~is_early)
    capped = over_columns(early, "lab1", lambda c: cap_above(c, 250000.0))
    return bind_rows(capped.withColumn("part", F.lit("early")), late.withColumn("part", F.lit("late")))


@query(
    "stacked_extracts",
    """
SELECT id, visit, lab1, NULL::INT AS dx FROM visits WHERE lab1 IS NOT NULL
UNION ALL
SELECT id, visit, NULL::DOUBLE AS lab1, dx FROM visits WHERE dx IS NOT NULL""",
    "visits",
)
def stacked_extracts(spark, sf_dir):
    rows = views.visits(spark, sf_dir)
    labs = rows.filter(F.col("lab1").isNotNull()).select("id", "visit", "lab1")
    known = rows.filter(F.col("dx").isNotNull()).select("id", "visit", "dx")
    return bind_rows(labs, known)


@query(
    "disease_flags",
    """
SELECT id, visit,
       CAST(lab1 > 250000 AS INT) AS hi_a,
       CAST(lab3 <= 7 AS INT) AS low_b,
       CAST((lab1 > 400000) OR (lab3 < 12) AS INT) AS either_c,
       CAST(lab2 >= 600000 AS INT) AS hi_d,
       CAST(lab2 >= 900000 AS INT) AS very_hi_d,
       CAST((lab1 >= 300000) OR (lab2 >= 500000) AS INT) AS either_e,
       CAST(lab3 >= 40 AS INT) AS hi_f
FROM visits""",
    "visits",
)
def disease_flags(spark, sf_dir):
    lab1, lab2, lab3 = F.col("lab1"), F.col("lab2"), F.col("lab3")
    tests = {
        "hi_a": lab1 > 250000,
        "low_b": lab3 <= 7,
        "either_c": (lab1 > 400000) | (lab3 < 12),
        "hi_d": lab2 >= 600000,
        "very_hi_d": lab2 >= 900000,
        "either_e": (lab1 >= 300000) | (lab2 >= 500000),
        "hi_f": lab3 >= 40,
    }
    return views.visits(spark, sf_dir).select(
        "id", "visit", *[as_flag(test).alias(name) for name, test in tests.items()]
    )


def _domain_sql(name: str) -> str:
    """Keys and columns of a domain, by the rule of ``views.study_visits``."""
    fields = {f.name: (j, f.dataType.simpleString()) for j, f in enumerate(RAW_SCHEMAS["visit_raw"])}
    cells = []
    for c in DOMAINS[name].split():
        j, kind = fields[c]
        value = f"(o_orderkey + {j}) % 97 / 2e0" if kind == "double" else f"CAST((o_orderkey + {j}) % 2 AS INT)"
        cells.append(f"CASE WHEN (o_orderkey + {j}) % 5 <> 0 THEN {value} END AS {c}")
    bins = " ".join(
        f"WHEN yr > {low} AND yr <= {high} THEN '{label}'"
        for low, high, label in zip(PERIOD_BREAKS, PERIOD_BREAKS[1:], PERIODS)
    )
    return f"""
SELECT o_custkey AS id, CAST(o_orderkey AS INT) AS visit, CAST(o_orderdate AS DATE) AS visdate,
       CASE {bins} END AS enroll_period, {', '.join(cells)}
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn
      FROM orders) o
LEFT JOIN (SELECT c_custkey, year(DATE '1988-01-01' + CAST(c_custkey % 11000 AS INT)) AS yr FROM customer) c
ON o_custkey = c_custkey
WHERE rn = 1"""


def _domain(spark, sf_dir, name):
    return domain_table(enriched_visits(views.study_visits(spark, sf_dir), views.enrolment(spark, sf_dir)), name)


@query("domain_mental", _domain_sql("mental"))
def domain_mental(spark, sf_dir):
    return _domain(spark, sf_dir, "mental")


@query("domain_hiv", _domain_sql("hiv"))
def domain_hiv(spark, sf_dir):
    return _domain(spark, sf_dir, "hiv")


@query(
    "domain_base",
    f"""
SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY visdate, visit) AS k FROM ({_domain_sql("base")}) d) f
WHERE k = 1""",
)
def domain_base(spark, sf_dir):
    return _domain(spark, sf_dir, "base")
