"""Registration of queries, and the SQL building blocks of their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named SQL steps: the steps each one reads, and its text.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, text: str, *needs: str) -> None:
    """Declare a named step that oracle queries can build on."""
    STEPS[name] = (needs, text)


def sql(final: str, *needs: str) -> str:
    """``final`` preceded by the steps it needs, each once, in reading order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in STEPS[name][0]:
                visit(need)
            order.append(name)

    for need in needs:
        visit(need)
    steps = ",\n".join(f"{name} AS ({STEPS[name][1].strip()})" for name in order)
    return f"WITH RECURSIVE {steps}\n{final.strip()}" if steps else final.strip()


def query(name: str, final: str | None = None, *needs: str):
    """Register a query under ``name`` with its twin, if SQL can express it."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        run.__name__ = build.__name__
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if final is not None:
            ORACLES[name] = sql(final, *needs)
        return build

    return add


step(
    "subjects",
    """
SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_custkey % 2 AS INT) AS sex01,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey % 2 END AS grp01,
       c_acctbal AS score, CAST(1985 + c_custkey % 36 AS INT) AS yr_enroll
FROM customer""",
)
step(
    "visits",
    """
SELECT id, visit, visdate, lab1, lab2, lab3, dx, tx, used
FROM (SELECT o_custkey AS id, o_orderkey AS visit, CAST(o_orderdate AS DATE) AS visdate,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS lab1,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 2 END AS lab2,
             CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END AS lab3,
             CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '4-NOT SPECIFIED' THEN NULL ELSE 0 END AS dx,
             CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS tx,
             CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INT) END AS used,
             row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)
                                ORDER BY o_orderkey) AS rn
      FROM orders) t
WHERE rn = 1""",
)
step(
    "numbered",
    """
SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY visdate) AS INT) AS n_vis
FROM visits""",
    "visits",
)
step(
    "deaths",
    """
SELECT c_custkey AS id, DATE '1999-01-01' + CAST(c_custkey % 1095 AS INT) AS dod
FROM customer WHERE c_acctbal < 0""",
)
step(
    "registry",
    """
SELECT l_orderkey AS rec, l_linenumber AS ln, o_custkey AS id,
       CASE WHEN l_linenumber = 7 THEN 'NA'
            ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS dx_date,
       CASE WHEN l_orderkey % 9 = 0 THEN 'NA' ELSE p_type END AS kind,
       CASE WHEN l_orderkey % 4 = 0 THEN 'NA' ELSE CAST(l_orderkey % 10 AS VARCHAR) END AS stage_a,
       CASE WHEN l_orderkey % 3 = 0 THEN 'NA' ELSE CAST(l_partkey % 10 AS VARCHAR) END AS stage_b,
       CASE WHEN l_returnflag = 'A' THEN 'NA' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS tx1,
       CASE WHEN l_linestatus = 'F' THEN 'NA' ELSE CAST(year(l_shipdate) + 1 AS VARCHAR) END AS tx2
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
)
step(
    "prognosis",
    """
SELECT p_type AS site, CASE WHEN p_brand < 'Brand#2' THEN 'Localized' ELSE 'Distant' END AS stage,
       avg(p_size / 50e0) AS survival, count(*) AS n
FROM part GROUP BY 1, 2""",
)
