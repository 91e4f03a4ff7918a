"""Shape of the physical plans, and one person holding a third of all rows."""

import re

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as contract
from panelspark.operators import panel
from panelspark.operators.keys import collapse, first_per_key

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"forest_impute", "forest_audit", "impute_error"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(df))


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - SLOW))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def keys(df) -> list[str]:
    return [re.sub(r"#\d+L?", "", s) for s in shuffles(df)]


def test_episodes_take_one_shuffle_after_the_day_grain(spark, no_broadcast):
    assert sorted(keys(contract.queries()["confirmed_episode"](spark, SF_DIR))) == ["id", "id, visdate"]


def test_whole_follow_up_shares_one_placement_by_person(spark, no_broadcast):
    found = keys(contract.queries()["initial_state"](spark, SF_DIR))
    # Visits, first registry date per person, deaths; then the day grain and the registry joins.
    assert sorted(found) == ["id", "id", "id", "id, visdate", "l_orderkey", "l_partkey", "o_orderkey", "p_partkey"]


def test_joins_on_person_and_date_reuse_the_person_placement(spark, no_broadcast):
    from panelspark.operators.keys import star_join
    from panelspark.sources import views

    rows = panel.visit_number(views.visits(spark, SF_DIR))
    on = ["id", "n_vis", "visdate"]
    star = star_join(rows.select(*on), [rows.select(*on, "lab1"), rows.select(*on, "dx")], on)
    # Per side the day grain and the person; none for the joins.
    assert sorted(keys(star)) == ["id"] * 3 + ["id, visdate"] * 3


def test_star_of_a_written_parent_needs_no_shuffle(spark, no_broadcast):
    assert "Exchange" not in plan_of(contract.queries()["visit_star"](spark, SF_DIR))


def test_year_window_reaches_the_scan(spark):
    df = contract.queries()["year_window"](spark, SF_DIR)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(formatted)
    pushed = re.search(r"PushedFilters: .*", plan).group(0)
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in pushed
    assert "LessThan(o_orderdate,2000-01-01" in pushed


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(contract.queries()["ceil_score"](spark, SF_DIR))
    assert "o_totalprice" not in plan and "o_orderstatus" not in plan


def test_rows_are_reduced_before_the_shuffle(spark):
    raw = spark.range(100).select((F.col("id") % 3).alias("id"), F.col("id").alias("visit"))
    assert "partial_min" in plan_of(collapse(raw.withColumn("visdate", F.lit(1)), ["id", "visdate"], "visit"))
    before = plan_of(first_per_key(raw, "id", "visit"))
    assert before.index("Final") < before.index("Exchange") < before.index("Partial")


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    """The test tables, with one person holding a third of all orders, many a day."""
    folder = tmp_path_factory.mktemp("hot")
    for name in ("customer", "lineitem", "part"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    shift = orders.agg(F.max("o_orderkey")).first()[0] + 1
    copies = orders.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).withColumns(
        {
            "o_orderkey": F.col("o_orderkey") + shift * F.col("copy"),
            "o_custkey": F.when(F.col("copy") == 0, F.lit(7).cast("long")).otherwise(F.col("o_custkey")),
        }
    )
    copies.drop("copy").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


HOT = ["confirmed_episode", "multimorbidity_count", "initial_state", "first_visit", "last_visit", "visit_star",
       "yearly_dropout", "running_sum_strict"]


@pytest.mark.parametrize("name", HOT)
def test_hot_person(spark, hot_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("customer", "lineitem", "part", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{hot_dir}/{table}.parquet/*.parquet'")
    assert difference(contract.queries()[name](spark, hot_dir), con, contract.oracle_sql()[name]) is None


def test_hot_person_is_bounded_by_days(spark, hot_dir):
    from panelspark.sources import views

    raw = views.raw_visits(spark, hot_dir)
    per_day = raw.groupBy("id", "visdate").count()
    assert raw.filter("id = 7").count() * 3 >= raw.count()
    days = raw.select("visdate").distinct().count()
    most = panel.visit_number(views.visits(spark, hot_dir)).agg(F.max("n_vis")).first()[0]
    assert most <= days and per_day.agg(F.max("count")).first()[0] > 1
