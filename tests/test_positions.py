"""Numbers of rows, binding by place and stable sorting over several files."""

import pytest
from checks import rows
from pyspark.sql import functions as F

from panelspark.operators import positions


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A table of 9 files of unequal size, one of them empty of matches, and a narrower one of 4."""
    root = str(tmp_path_factory.mktemp("positions"))
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(7)))
    df.repartitionByRange(9, F.col("id") * F.col("id")).sortWithinPartitions("id").write.parquet(f"{root}/a")
    df.select((F.col("id") * 10).alias("ten"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("gap")).coalesce(1).repartitionByRange(
        4, "ten"
    ).sortWithinPartitions("ten").write.parquet(f"{root}/b")
    return root


def test_numbers_follow_files_and_places(spark, stored):
    got = positions.number_rows(positions.in_file_order(spark, f"{stored}/a")).collect()
    assert len({r.row for r in got}) == 1000 and all(r.row == r.id for r in got)


def test_rows_of_a_file_are_not_gathered(spark, stored):
    """One large file must not become one task's work."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = positions.number_rows(positions.in_file_order(spark, f"{stored}/a"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Only the counts per file are dealt by file.
    assert plan.count("hashpartitioning(_file") == 1 and "SortMergeJoin" not in plan


def test_tables_of_unequal_partitions_are_bound_by_place(spark, stored):
    a, b = (positions.in_file_order(spark, f"{stored}/{n}") for n in "ab")
    got = rows(positions.bind_columns(a, b, row="at"), "id", "ten", "gap", "at")
    assert got == sorted((i, i * 10, i if i % 3 else None, i) for i in range(1000))


def test_any_rows_keep_the_order_of_their_partitions(spark):
    df = spark.range(300, numPartitions=7).select((300 - F.col("id")).alias("down"))
    other = spark.range(300, numPartitions=2).select(F.col("id").alias("up"))
    got = positions.bind_columns(positions.written_order(df), positions.written_order(other)).collect()
    assert len(got) == 300 and all(r.down == 300 - r.up for r in got)


def test_unequal_length_and_equal_names_are_errors(spark, stored):
    a = positions.in_file_order(spark, f"{stored}/a")
    with pytest.raises(ValueError, match="both tables"):
        positions.bind_columns(a, a)
    with pytest.raises(ValueError, match="cannot bind"):
        positions.bind_columns(a, positions.written_order(spark.range(999).withColumnRenamed("id", "x")))


def test_ties_keep_file_order(spark, stored):
    df = positions.in_file_order(spark, f"{stored}/a")
    got = [(r.k, r.id) for r in df.orderBy("k", *positions.file_order()).collect()]
    assert got == sorted(got)


def test_empty_tables(spark):
    none = positions.written_order(spark.range(0).withColumnRenamed("id", "a"))
    assert positions.bind_columns(none, positions.written_order(spark.range(0))).collect() == []
