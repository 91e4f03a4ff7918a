"""Queries on first and last rows, joins, and long or wide shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.book import query, step
from panelspark.functions import days_between, keep_levels, years_between
from panelspark.operators import reshape
from panelspark.operators.keys import (
    first_per_key,
    join_on,
    last_per_key,
    over_columns,
    repeated_keys,
    star_join,
)
from panelspark.operators.panel import person_order, visit_number
from panelspark.sources import views
from panelspark.sources.tables import settle

step(
    "first_rows",
    """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY visdate, visit) AS rn FROM visits)
WHERE rn = 1""",
    "visits",
)


@query("first_visit", "SELECT * FROM first_rows", "first_rows")
def first_visit(spark, sf_dir):
    # Straight from the raw rows: the first order of the first day.
    return first_per_key(views.raw_visits(spark, sf_dir), "id", ["visdate", "visit"])


@query(
    "last_visit",
    """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY visdate DESC, visit DESC) AS rn
  FROM visits)
WHERE rn = 1""",
    "visits",
)
def last_visit(spark, sf_dir):
    # The first order of the last day, again straight from the raw rows.
    return last_per_key(views.raw_visits(spark, sf_dir), "id", "visdate", then="visit")


@query(
    "baseline_snapshot",
    """
SELECT id, visit, visdate, segment, sex01, grp01, score, yr_enroll, lab1, dx
FROM first_rows LEFT JOIN subjects USING (id)""",
    "first_rows",
    "subjects",
)
def baseline_snapshot(spark, sf_dir):
    first = first_per_key(views.raw_visits(spark, sf_dir), "id", ["visdate", "visit"])
    return join_on(first, views.subjects(spark, sf_dir), "id").select(
        "id", "visit", "visdate", "segment", "sex01", "grp01", "score", "yr_enroll", "lab1", "dx"
    )


@query(
    "enroll_attributes",
    "SELECT * FROM visits LEFT JOIN subjects USING (id)",
    "visits",
    "subjects",
)
def enroll_attributes(spark, sf_dir):
    return join_on(views.visits(spark, sf_dir), views.subjects(spark, sf_dir), "id")


@query(
    "baseline_right",
    """
SELECT id, segment, sex01, grp01, visdate, lab1
FROM subjects RIGHT JOIN (SELECT id, visdate, lab1 FROM first_rows WHERE lab1 IS NOT NULL)
USING (id)""",
    "subjects",
    "first_rows",
)
def baseline_right(spark, sf_dir):
    persons = views.subjects(spark, sf_dir).select("id", "segment", "sex01", "grp01")
    first = first_per_key(views.raw_visits(spark, sf_dir), "id", ["visdate", "visit"])
    known = first.filter(F.col("lab1").isNotNull()).select("id", "visdate", "lab1")
    return join_on(persons, known, "id", "right")


# Measures of each extract.
DOMAINS = {"labs": ["lab1", "lab2", "lab3"], "treatment": ["dx", "tx"], "use": ["used", "grp01"]}


@query(
    "domain_extracts",
    """
SELECT 'labs' AS domain, id, visdate,
       (lab1 IS NOT NULL)::INT + (lab2 IS NOT NULL)::INT + (lab3 IS NOT NULL)::INT AS n_known
FROM visits
UNION ALL
SELECT 'treatment', id, visdate, (dx IS NOT NULL)::INT + (tx IS NOT NULL)::INT FROM visits
UNION ALL
SELECT 'use', id, visdate, (used IS NOT NULL)::INT + (grp01 IS NOT NULL)::INT
FROM visits LEFT JOIN subjects USING (id)""",
    "visits",
    "subjects",
)
def domain_extracts(spark, sf_dir):
    # All extracts leave one scan together instead of one scan each.
    persons = views.subjects(spark, sf_dir).select("id", "grp01")
    rows = join_on(views.visits(spark, sf_dir), persons, "id")

    def known(columns):
        return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))

    extracts = [
        F.struct(F.lit(name).alias("domain"), known(columns).alias("n_known"))
        for name, columns in DOMAINS.items()
    ]
    return rows.select("id", "visdate", F.inline(F.array(*extracts)))


@query(
    "time_on_study",
    """
SELECT id, visdate, CAST(date_diff('day', basdate, visdate) AS INT) AS days_study,
       round(date_diff('day', basdate, visdate) / 365.25e0, 4) AS yrs_study,
       CAST(year(basdate) AS INT) AS yr_enroll
FROM (SELECT id, visdate, min(visdate) OVER (PARTITION BY id) AS basdate FROM visits)""",
    "visits",
)
def time_on_study(spark, sf_dir):
    rows = views.visits(spark, sf_dir).select(
        "id", "visdate", F.first("visdate").over(person_order()).alias("basdate")
    )
    return rows.select(
        "id",
        "visdate",
        days_between("basdate", "visdate").alias("days_study"),
        F.round(years_between("basdate", "visdate"), 4).alias("yrs_study"),
        F.year("basdate").alias("yr_enroll"),
    )


@query(
    "visit_merge",
    """
SELECT a.id, a.visdate, a.lab1, a.dx, b.lab2, b.used
FROM (SELECT id, visdate, lab1, dx FROM visits) a
LEFT JOIN (SELECT id, visdate, lab2, used FROM visits WHERE lab2 IS NOT NULL) b
ON a.id = b.id AND a.visdate = b.visdate""",
    "visits",
)
def visit_merge(spark, sf_dir):
    rows = views.visits(spark, sf_dir)
    labs = rows.filter(F.col("lab2").isNotNull()).select("id", "visdate", "lab2", "used")
    return join_on(rows.select("id", "visdate", "lab1", "dx"), labs, ["id", "visdate"])


# Each measure with the rows it is known on.
STAR = ["lab1", "lab2", "lab3", "dx", "tx", "used"]


@query(
    "visit_star",
    """
SELECT v.id, v.n_vis, v.visdate, a.lab1, b.lab2, c.lab3, d.dx, e.tx, f.used
FROM numbered v
LEFT JOIN (SELECT id, n_vis, visdate, lab1 FROM numbered WHERE lab1 IS NOT NULL) a USING (id, n_vis, visdate)
LEFT JOIN (SELECT id, n_vis, visdate, lab2 FROM numbered WHERE lab2 IS NOT NULL) b USING (id, n_vis, visdate)
LEFT JOIN (SELECT id, n_vis, visdate, lab3 FROM numbered WHERE lab3 IS NOT NULL) c USING (id, n_vis, visdate)
LEFT JOIN (SELECT id, n_vis, visdate, dx FROM numbered WHERE dx IS NOT NULL) d USING (id, n_vis, visdate)
LEFT JOIN (SELECT id, n_vis, visdate, tx FROM numbered WHERE tx = 1) e USING (id, n_vis, visdate)
LEFT JOIN (SELECT id, n_vis, visdate, used FROM numbered WHERE used IS NOT NULL) f USING (id, n_vis, visdate)""",
    "numbered",
)
def visit_star(spark, sf_dir):
    # Seven tables leave one parent, so it is written once, placed by person.
    on = ["id", "n_vis", "visdate"]
    rows = settle(visit_number(views.visits(spark, sf_dir)), "numbered")
    sides = [
        rows.filter(F.col("tx") == 1 if name == "tx" else F.col(name).isNotNull()).select(*on, name)
        for name in STAR
    ]
    return star_join(rows.select(*on), sides, on)


# Every person with every visit number that occurs, observed or not.
step(
    "all_cells",
    """
SELECT p.id, n.n_vis, v.lab1, v.dx, v.visdate
FROM (SELECT DISTINCT id FROM numbered) p
CROSS JOIN (SELECT DISTINCT n_vis FROM numbered) n
LEFT JOIN numbered v ON v.id = p.id AND v.n_vis = n.n_vis""",
    "numbered",
)


def _wide(spark, sf_dir):
    return reshape.pivot_visits(visit_number(views.visits(spark, sf_dir)), ["lab1", "dx"], dense=True)


@query(
    "pivot_visits",
    """
SELECT id, 'lab1_' || n_vis AS cell, lab1 AS value FROM all_cells
UNION ALL
SELECT id, 'dx_' || n_vis, CAST(dx AS DOUBLE) FROM all_cells""",
    "all_cells",
)
def pivot_visits(spark, sf_dir):
    # The matrix has as many columns as the longest person has visits, so it is
    # compared cell by cell, empty ones and column names included.
    return reshape.melt(_wide(spark, sf_dir))


@query("unpivot_measure", "SELECT id, n_vis, lab1 FROM all_cells", "all_cells")
def unpivot_measure(spark, sf_dir):
    return reshape.unpivot_measure(_wide(spark, sf_dir), "lab1")


@query("unpivot_many", "SELECT id, n_vis, lab1, dx FROM all_cells", "all_cells")
def unpivot_many(spark, sf_dir):
    return reshape.unpivot_many(_wide(spark, sf_dir))


@query("observed_cells", "SELECT id, visdate, n_vis, lab1, dx FROM numbered", "numbered")
def observed_cells(spark, sf_dir):
    # Cells come from the packed form, which holds no cell of an unobserved visit.
    numbered = visit_number(views.visits(spark, sf_dir))
    cells = reshape.unpack_visits(reshape.pack_visits(numbered, ["lab1", "dx"]))
    return reshape.observed_cells(numbered.select("id", "visdate", "n_vis"), cells)


@query(
    "visit_matrix",
    """
SELECT a.id, cell, CASE WHEN grp01 IS NULL THEN NULL ELSE CAST(grp01 AS INT) END AS grp01, value
FROM (SELECT id, 'lab1_' || n_vis AS cell, lab1 AS value FROM all_cells
      UNION ALL
      SELECT id, 'dx_' || n_vis, CAST(CASE WHEN dx IN (0, 1) THEN dx END AS DOUBLE) FROM all_cells
      UNION ALL
      SELECT id, 'yr_' || n_vis,
             CAST(CASE WHEN year(visdate) BETWEEN 1996 AND 2000 THEN year(visdate) END AS DOUBLE) FROM all_cells) a
LEFT JOIN subjects USING (id)""",
    "all_cells",
    "subjects",
)
def visit_matrix(spark, sf_dir):
    # Levels are checked on the long rows, once per cell that exists.
    persons = views.subjects(spark, sf_dir).select("id", F.col("grp01").cast("int").alias("grp01"))
    rows = visit_number(views.visits(spark, sf_dir)).withColumn("yr", F.year("visdate"))
    rows = over_columns(rows, ["dx"], lambda c: keep_levels(c, [0, 1]))
    rows = over_columns(rows, ["yr"], lambda c: keep_levels(c, range(1996, 2001)))
    # The person's columns join the packed visits, before there are many columns.
    measures = ["lab1", "dx", "yr"]
    matrix = join_on(persons, reshape.pack_visits(rows, measures), "id", "right")
    wide = reshape.widen(matrix, measures, reshape.visit_numbers(rows), persons.columns, dense=True)
    return reshape.melt(wide, persons.columns)


@query(
    "study_order",
    """
SELECT id, visdate, lab2, CAST(row_number() OVER (PARTITION BY id ORDER BY lab2 ASC NULLS LAST, visdate) AS INT) AS place
FROM visits""",
    "visits",
)
def study_order(spark, sf_dir):
    """Visits of a person from the lowest measure on, missing ones last."""
    rows = views.visits(spark, sf_dir).select("id", "visdate", "lab2")
    order = person_order("id", ["lab2", "visdate"])
    return rows.withColumn("place", F.row_number().over(order))


@query(
    "repeated_days",
    "SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS visdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
)
def repeated_days(spark, sf_dir):
    """Person-days whose rows would multiply a join."""
    return repeated_keys(views.raw_visits(spark, sf_dir), ["id", "visdate"])
