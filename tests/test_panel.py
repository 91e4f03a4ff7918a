import datetime as dt
import random

import pytest
from checks import rows
from pyspark.sql import functions as F

from panelspark.operators import panel

DAY = dt.date(2008, 1, 1)


def visits(spark, spec, schema="id int, visdate date, x int"):
    return spark.createDataFrame(spec, schema)


def timeline(spark, values, person=1, gap=30):
    return visits(spark, [(person, DAY + dt.timedelta(days=gap * i), v) for i, v in enumerate(values)])


def in_order(df, column):
    return [r[column] for r in df.orderBy("id", "visdate").collect()]


def test_running_sum_is_lost_at_a_gap(spark):
    df = timeline(spark, [1, None, 2])
    w = panel.person_order()
    assert in_order(df.withColumn("s", panel.running_sum("x", w)), "s") == [1, None, None]
    assert in_order(df.withColumn("s", panel.running_sum("x", w, skip_nulls=True)), "s") == [1, 1, 3]


def test_only_the_first_flag_is_marked(spark):
    assert in_order(panel.mark_first(timeline(spark, [0, 1, None, 1]), "x", "m"), "m") == [0, 1, 0, 0]


def test_rows_after_the_first_flag_go(spark):
    assert in_order(panel.keep_through_first(timeline(spark, [0, 1, 0, 1]), "x"), "x") == [0, 1]


def test_missing_dates_come_last(spark):
    df = visits(spark, [(1, None, 3), (1, DAY, 1), (1, DAY + dt.timedelta(days=1), 2)])
    numbered = panel.visit_number(df)
    assert sorted((r["x"], r["n_vis"]) for r in numbered.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_previous_value_default_is_for_a_missing_row_only(spark):
    df = panel.with_previous(timeline(spark, [None, 5, 6]), {"p": "x"}, default=0)
    assert in_order(df, "p") == [0, None, 5]


def test_intervals(spark):
    out = panel.intervals(timeline(spark, [1, 2, 3]))
    assert in_order(out, "gap_days") == [30, 30] and in_order(out, "visdate0")[0] == DAY


def test_close_pairs(spark):
    days = [dt.date(2008, 2, 29), dt.date(2009, 2, 28), dt.date(2010, 2, 27)]
    df = visits(spark, [(1, d, 1) for d in days])
    assert in_order(panel.close_pairs(df), "close") == [0, 0, 1]


def test_pair_is_confirmed_across_a_normal_visit(spark):
    out = panel.confirmed_episode(timeline(spark, [9, 1, 9, 9], gap=100), F.col("x") > 5)
    assert in_order(out, "visdate") == [DAY + dt.timedelta(days=200)]


def filter_and_join_back(df, cond):
    """The long way: keep elevated rows, pair them, mark the first, join to all rows."""
    pairs = panel.close_pairs(df.filter(cond))
    first = panel.mark_first(pairs, "close", "idx").filter("idx = 1").select("id", "visdate", "idx")
    return df.join(first, ["id", "visdate"], "left").withColumn("idx", F.coalesce("idx", F.lit(0)))


@pytest.mark.parametrize("cut", [3, 6, 9])
def test_one_pass_equals_filter_and_join_back(spark, cut):
    rng = random.Random(cut)
    spec = {(rng.randrange(40), DAY + dt.timedelta(days=rng.randrange(2000))) for _ in range(900)}
    df = visits(spark, [(p, d, rng.choice([None, *range(11)])) for p, d in sorted(spec)])
    cond = F.col("x") > cut
    one = panel.mark_confirmed(df, {"idx": cond})
    assert rows(one, "id", "visdate", "idx") == rows(filter_and_join_back(df, cond), "id", "visdate", "idx")
    assert one.filter("idx = 1").count() > 5


def test_absorbing_condition(spark):
    df = timeline(spark, [0, 1, 0]).withColumn("t", F.when(F.col("x") == 1, F.lit(None)).otherwise(F.lit(0)))
    out = panel.absorbing(df, {"a": ["x"], "b": ["x", "t"]})
    assert in_order(out, "a") == [0, 1, 1] and in_order(out, "b") == [0, None, None]
    assert in_order(panel.absorbing(df, {"b": ["x", "t"]}, skip_nulls=True), "b") == [0, 1, 1]
