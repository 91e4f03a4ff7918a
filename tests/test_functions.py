import datetime as dt

import pytest
from checks import rows
from pyspark.sql import functions as F

from panelspark import functions as fn


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_strict_if_keeps_an_unknown_condition(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, c boolean")
    assert rows(df.select("k", fn.strict_if(F.col("c"), F.lit("a"), F.lit("b")))) == [(1, "a"), (2, "b"), (3, None)]


@pytest.mark.parametrize("value,high,low", [(None, None, None), (94.0, 94.0, 95.0), (96.0, 95.0, 96.0)])
def test_caps_keep_missing_values(spark, value, high, low):
    assert one(spark, value, "double", fn.cap_above("x", 95.0)) == high
    assert one(spark, value, "double", fn.cap_below("x", 95.0)) == low


def test_a_missing_value_is_in_no_set(spark):
    assert one(spark, None, "string", fn.in_set("x", ["a", "b"])) is False
    assert one(spark, None, "string", ~fn.in_set("x", ["a", "b"])) is True


def test_any_equal_is_never_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 0), (3, 1, None)], "k int, a int, b int")
    assert rows(df.select("k", fn.any_equal(["a", "b"], 1))) == [(1, False), (2, False), (3, True)]


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 1, None)], "k int, a int, b int")
    assert rows(df.select("k", fn.strict_sum(["a", "b"]))) == [(1, 3), (2, None)]


def test_ratio_of_nothing_is_missing(spark):
    df = spark.createDataFrame([(0, 0), (1, 2)], "a int, b int")
    assert rows(df.select("a", fn.ratio("a", "b"))) == [(0, None), (1, 0.5)]


@pytest.mark.parametrize(
    "year,label",
    [(1987, None), (1988, "p1"), (1992, "p1"), (1993, "p2"), (1997, "p2"), (2004, "p4"), (2018, "p5"), (2019, None), (None, None)],
)
def test_bins_are_right_closed(spark, year, label):
    breaks = [1987, 1992, 1997, 2001, 2015, 2018]
    assert one(spark, year, "int", fn.right_closed_bins("x", breaks, ["p1", "p2", "p3", "p4", "p5"])) == label


@pytest.mark.parametrize(
    "text,number",
    [("NA", None), (" 12 ", 12.0), ("12d", None), ("12f", None), ("", None), ("-1.5e2", -150.0), (".5", 0.5), ("7.", 7.0), (None, None)],
)
def test_parse_number(spark, text, number):
    assert one(spark, text, "string", fn.parse_number("x")) == number


@pytest.mark.parametrize(
    "text,day",
    [
        ("2011-01-05", dt.date(2011, 1, 5)),
        ("20110105", dt.date(2011, 1, 5)),
        ("2011/01/05", dt.date(2011, 1, 5)),
        ("2011/1/5", dt.date(2011, 1, 5)),
        (" 2011-1-5 ", dt.date(2011, 1, 5)),
        ("NA", None),
        ("2011-02-30", None),
        ("20110230", None),
        ("2011", None),
        (None, None),
    ],
)
def test_parse_ymd(spark, text, day):
    assert one(spark, text, "string", fn.parse_ymd("x")) == day


def test_parse_ymd_of_a_number(spark):
    assert one(spark, 20110105, "int", fn.parse_ymd("x")) == dt.date(2011, 1, 5)


@pytest.mark.parametrize("text,year", [("20110105", 2011), ("2011", 2011), ("NA", None), ("201", None), (None, None)])
def test_parse_year(spark, text, year):
    assert one(spark, text, "string", fn.parse_year("x")) == year


@pytest.mark.parametrize(
    "earlier,later,close",
    [
        ("2008-02-29", "2009-02-27", True),
        ("2008-02-29", "2009-02-28", False),
        ("2009-01-01", "2010-01-01", False),
        ("2009-01-01", "2009-12-31", True),
        (None, "2010-01-01", False),
    ],
)
def test_within_years(spark, earlier, later, close):
    df = spark.createDataFrame([(earlier, later)], "a string, b string")
    a, b = F.col("a").cast("date"), F.col("b").cast("date")
    assert df.select(fn.within_years(a, b)).first()[0] is close


def test_recoding(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    codes = {"a": "A", "b": "B"}
    assert rows(df.select("x", fn.look_up("x", codes), fn.recode("x", codes))) == [("a", "A", "A"), ("z", None, "z"), (None, None, None)]


def test_levels(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "x int")
    assert rows(df.select("x", fn.keep_levels("x", [0, 1]))) == [(0, 0), (1, 1), (7, None), (None, None)]


def test_first_match_skips_unknown_conditions(spark):
    rules = [(F.col("x") > 5, "high"), (F.col("x") > 1, "mid")]
    assert one(spark, None, "int", fn.first_match(rules, "rest")) == "rest"
    assert one(spark, None, "int", fn.first_match(rules)) is None
    assert one(spark, 9, "int", fn.first_match(rules)) == "high"


def test_sentinel_and_back(spark):
    df = spark.createDataFrame([(None, 3.0), (None, None), (1.0, 2.0)], "a double, b double")
    filled = fn.fill_sentinel("a", "b", sentinel=99.0)
    assert sorted(r[0] for r in df.select(filled).collect()) == [1.0, 3.0, 99.0]
    assert df.select(fn.null_if(filled, 99.0).alias("y")).filter("y is null").count() == 1
