"""Queries on the ordered visits of a person."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.book import query, step
from panelspark.catalog.records import with_event
from panelspark.functions import strict_sum
from panelspark.operators import panel
from panelspark.sources import views

def elevated():
    """Condition of an elevated value per measure."""
    return {
        "lab1": F.col("lab1") > 250000,
        "lab2": F.col("lab2") > 600000,
        "lab3": F.col("lab3") >= 40,
    }


def _episode(name: str, cut: str) -> str:
    """First visit elevated less than a year after the previous elevated one."""
    return f"""
SELECT id, visdate, '{name}' AS measure FROM (
  SELECT *, sum(pair) OVER (PARTITION BY id ORDER BY visdate) AS pairs FROM (
    SELECT id, visdate,
           CASE WHEN visdate < CAST(lag(visdate) OVER (PARTITION BY id ORDER BY visdate)
                                    + INTERVAL 1 YEAR AS DATE) THEN 1 ELSE 0 END AS pair
    FROM visits WHERE {cut}))
WHERE pair = 1 AND pairs = 1"""


step(
    "episodes",
    " UNION ALL ".join(
        [
            _episode("lab1", "lab1 > 250000"),
            _episode("lab2", "lab2 > 600000"),
            _episode("lab3", "lab3 >= 40"),
        ]
    ),
    "visits",
)


@query(
    "visit_number",
    "SELECT id, visit, visdate, n_vis FROM numbered",
    "numbered",
)
def visit_number(spark, sf_dir):
    return panel.visit_number(views.visits(spark, sf_dir).select("id", "visit", "visdate"))


@query(
    "intervals",
    """
SELECT id, visit, visdate0, visdate, CAST(date_diff('day', visdate0, visdate) AS INT) AS gap_days
FROM (SELECT *, lag(visdate) OVER (PARTITION BY id ORDER BY visdate) AS visdate0 FROM visits)
WHERE visdate0 IS NOT NULL""",
    "visits",
)
def intervals(spark, sf_dir):
    return panel.intervals(views.visits(spark, sf_dir).select("id", "visit", "visdate"))


@query(
    "close_pair_flag",
    """
SELECT id, visit, visdate,
       CASE WHEN visdate < CAST(lag(visdate) OVER (PARTITION BY id ORDER BY visdate)
                                + INTERVAL 1 YEAR AS DATE) THEN 1 ELSE 0 END AS close
FROM visits WHERE lab1 > 250000""",
    "visits",
)
def close_pair_flag(spark, sf_dir):
    high = views.visits(spark, sf_dir).filter(F.col("lab1") > 250000)
    return panel.close_pairs(high.select("id", "visit", "visdate"))


@query(
    "first_flag",
    """
SELECT id, visit, visdate, tx,
       CASE WHEN tx = 1 AND sum(tx) OVER (PARTITION BY id ORDER BY visdate) = 1 THEN 1 ELSE 0 END AS first_tx
FROM visits""",
    "visits",
)
def first_flag(spark, sf_dir):
    rows = views.visits(spark, sf_dir).select("id", "visit", "visdate", "tx")
    return panel.mark_first(rows, "tx", "first_tx")


@query(
    "running_sum_strict",
    """
SELECT id, visit, visdate, dx,
       CASE WHEN count(*) FILTER (WHERE dx IS NULL) OVER w = 0 THEN CAST(sum(dx) OVER w AS BIGINT) END AS total
FROM visits WINDOW w AS (PARTITION BY id ORDER BY visdate)""",
    "visits",
)
def running_sum_strict(spark, sf_dir):
    rows = views.visits(spark, sf_dir).select("id", "visit", "visdate", "dx")
    return rows.withColumn("total", panel.running_sum("dx", panel.person_order()))


def marked(spark, sf_dir):
    """Visits with a 0/1 marker per measure at its first confirmed episode."""
    flags = {f"{name}_idx": cond for name, cond in elevated().items()}
    return panel.mark_confirmed(views.visits(spark, sf_dir), flags)


@query("confirmed_episode", "SELECT id, visdate, measure FROM episodes", "episodes")
def confirmed_episode(spark, sf_dir):
    names = list(elevated())
    found = F.filter(
        F.array(*[F.when(F.col(f"{n}_idx") == 1, F.lit(n)) for n in names]), lambda m: m.isNotNull()
    )
    return marked(spark, sf_dir).select("id", "visdate", F.explode(found).alias("measure"))


step(
    "marked",
    """
SELECT v.*, CAST(a.id IS NOT NULL AS INT) AS lab1_idx, CAST(b.id IS NOT NULL AS INT) AS lab2_idx,
       CAST(c.id IS NOT NULL AS INT) AS lab3_idx
FROM visits v
LEFT JOIN (SELECT id, visdate FROM episodes WHERE measure = 'lab1') a USING (id, visdate)
LEFT JOIN (SELECT id, visdate FROM episodes WHERE measure = 'lab2') b USING (id, visdate)
LEFT JOIN (SELECT id, visdate FROM episodes WHERE measure = 'lab3') c USING (id, visdate)""",
    "visits",
    "episodes",
)


@query(
    "absorbing_condition",
    """
SELECT id, visit, visdate,
       CAST(sum(lab1_idx + tx) OVER w >= 1 AS INT) AS cond_a,
       CASE WHEN count(*) FILTER (WHERE dx IS NULL) OVER w = 0
            THEN CAST(sum(lab2_idx + dx) OVER w >= 1 AS INT) END AS cond_b,
       CAST(sum(lab3_idx) OVER w >= 1 AS INT) AS cond_c
FROM marked WINDOW w AS (PARTITION BY id ORDER BY visdate)""",
    "marked",
)
def absorbing_condition(spark, sf_dir):
    triggers = {"cond_a": ["lab1_idx", "tx"], "cond_b": ["lab2_idx", "dx"], "cond_c": ["lab3_idx"]}
    return panel.absorbing(marked(spark, sf_dir), triggers).select(
        "id", "visit", "visdate", "cond_a", "cond_b", "cond_c"
    )


step(
    "counted",
    """
SELECT *, cond_a + cond_b + cond_c + event + used AS n_cond
FROM (SELECT m.id, m.visit, m.visdate, m.used, m.lab1, m.lab2, m.lab3,
             CAST(sum(lab1_idx + tx) OVER w >= 1 AS INT) AS cond_a,
             CAST(sum(lab2_idx + coalesce(dx, 0)) OVER w >= 1 AS INT) AS cond_b,
             CAST(sum(lab3_idx) OVER w >= 1 AS INT) AS cond_c,
             CASE WHEN e.dx_date IS NULL OR e.dx_date > m.visdate THEN 0 ELSE 1 END AS event
      FROM marked m LEFT JOIN (SELECT id, min(dx_date) AS dx_date FROM staged GROUP BY id) e USING (id)
      WINDOW w AS (PARTITION BY m.id ORDER BY m.visdate))""",
    "marked",
    "staged",
)


def counted(spark, sf_dir):
    """Visits with ever-flags and the number of conditions, NULL if a term is."""
    rows = marked(spark, sf_dir).withColumn("dx", F.coalesce("dx", F.lit(0)))
    triggers = {"cond_a": ["lab1_idx", "tx"], "cond_b": ["lab2_idx", "dx"], "cond_c": ["lab3_idx"]}
    rows = with_event(panel.absorbing(rows, triggers), spark, sf_dir)
    terms = ["cond_a", "cond_b", "cond_c", "event", "used"]
    return rows.withColumn("n_cond", strict_sum(terms)).drop(
        "lab1_idx", "lab2_idx", "lab3_idx", "dx", "tx"
    )


@query(
    "multimorbidity_count",
    "SELECT id, visit, visdate, cond_a, cond_b, cond_c, event, used, n_cond FROM counted",
    "counted",
)
def multimorbidity_count(spark, sf_dir):
    return counted(spark, sf_dir).drop("lab1", "lab2", "lab3")
