import pytest
from checks import rows
from pyspark.sql import functions as F

from panelspark.operators import keys


@pytest.fixture(scope="module")
def visits(spark):
    return spark.createDataFrame(
        [(1, 3, "c"), (1, 1, None), (1, None, "n"), (2, 5, "e"), (2, 4, "d")], "id int, day int, v string"
    )


def test_first_and_last_rows_keep_their_own_nulls(visits):
    assert rows(keys.first_per_key(visits, "id", "day")) == [(1, 1, None), (2, 4, "d")]
    assert rows(keys.last_per_key(visits, "id", "day")) == [(1, None, "n"), (2, 5, "e")]


def test_ties_on_the_last_order_value(spark):
    df = spark.createDataFrame([(1, 5, 8, "a"), (1, 5, 7, "b"), (1, 4, 1, "c")], "id int, day int, o int, v string")
    assert rows(keys.last_per_key(df, "id", "day", then="o")) == [(1, 5, 7, "b")]


def test_collapse_equals_first_per_key(spark):
    df = spark.range(400).select(
        (F.col("id") % 7).alias("k"), (F.col("id") % 5).alias("d"), F.col("id").alias("o"),
        F.when(F.col("id") % 3 != 0, F.col("id") * 2).alias("v"),
    )
    assert rows(keys.collapse(df, ["k", "d"], "o")) == rows(keys.first_per_key(df, ["k", "d"], "o"))


def test_joins_fan_out_unless_one_is_expected(spark, visits):
    other = spark.createDataFrame([(1, "x"), (1, "y")], "id int, w string")
    assert keys.join_on(visits, other, "id").count() == 8
    with pytest.raises(ValueError):
        keys.join_on(visits, other, "id", expect="one")
    assert keys.join_on(visits, other.limit(1), "id", expect="one").count() == 5


def test_missing_keys_match_only_when_asked(spark):
    a = spark.createDataFrame([(None, "x", 1), ("s", "y", 2)], "site string, stage string, k int")
    b = spark.createDataFrame([(None, "x", 10), ("s", None, 20)], "site string, stage string, v int")
    on = ["site", "stage"]
    assert rows(keys.join_on(a, b, on), "k", "v") == [(1, None), (2, None)]
    assert rows(keys.join_on(a, b, on, null_safe=True), "k", "v") == [(1, 10), (2, None)]
    assert keys.join_on(a, b, on, null_safe=True).columns == ["site", "stage", "k", "v"]
    right = keys.join_on(a, b, on, how="right", null_safe=True)
    assert rows(right, "site", "stage", "k", "v") == [("s", None, None, 20), (None, "x", 1, 10)]


def test_code_table_matches_missing_keys(spark):
    a = spark.createDataFrame([(None, 1), ("s", 2), ("t", 3)], "site string, k int")
    b = spark.createDataFrame([(None, 10), ("s", 20)], "site string, v int")
    joined = keys.attach_table(a, b, ["site"])
    assert rows(joined, "k", "v") == [(1, 10), (2, 20), (3, None)]


def test_keys_in_and_out(spark, visits):
    some = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    with_null = visits.unionByName(spark.createDataFrame([(None, 1, "z")], visits.schema))
    assert rows(keys.keep_keys(visits, some, "id").select("id").distinct()) == [(1,)]
    assert rows(keys.drop_keys(with_null, some, "id").select("id").distinct()) == [(2,), (None,)]
    assert rows(keys.drop_keys(with_null, some, "id", null_safe=True).select("id").distinct()) == [(2,)]
    assert rows(keys.keep_keys(with_null, some, "id", null_safe=True).select("id").distinct()) == [(1,), (None,)]


def test_bound_rows_fill_columns(spark, visits):
    more = spark.createDataFrame([(9, True)], "id int, dead boolean")
    out = keys.bind_rows(visits, more)
    assert out.columns == ["id", "day", "v", "dead"] and out.count() == 6


def test_prefix_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "GFR_1 int, gfr_2 int, other int")
    assert keys.with_prefix(df, "gfr") == ["GFR_1", "gfr_2"]


def test_columns_of_one_source_need_no_positional_bind(spark):
    """One projection gives what binding two column sets row by row gives."""
    from pyspark.sql import Window

    df = spark.range(50).select("id", (F.col("id") * 3).alias("a"), (F.col("id") % 4).alias("b"))
    w = Window.orderBy("id")
    left = df.select("a", F.row_number().over(w).alias("r"))
    right = df.select("b", F.row_number().over(w).alias("r"))
    assert rows(left.join(right, "r").drop("r"), "a", "b") == rows(df, "a", "b")
