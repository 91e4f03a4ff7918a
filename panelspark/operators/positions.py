"""Rows by their place: numbers over a whole table, binding by place, file order as a tie-breaker.

Parquet keeps the order of rows within a file, and Spark says for every row its file
and its place there. A row's number is its place plus the rows of all files before it,
so that only one row per file has to be ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources.stages import Stages

FILE, PLACE = "_file", "_place"


def in_file_order(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored Parquet table with each row's file and place in it as two more columns."""
    rows = spark.read.parquet(path)
    kept = list(columns) if columns else rows.columns
    return rows.select(*kept, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))


def written_order(df: DataFrame) -> DataFrame:
    """Any rows with file and place: written once, a file per partition, in the partitions' order."""
    stages = Stages(df.sparkSession, name="positions")
    stages.write(df, "rows")
    return in_file_order(df.sparkSession, f"{stages.root}/rows", df.columns)


def file_order() -> list[Column]:
    """Sort keys that put rows where their files have them; as last keys they make a sort stable.

    Longer names come later, as part numbers grow beyond their usual digits.
    """
    return [F.length(FILE), F.col(FILE), F.col(PLACE)]


def number_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """Rows of ``in_file_order`` or ``written_order`` with their number 0, 1, 2 ... instead of file and place.

    Rows must not have been filtered since: a number counts every row of the files.
    """
    files = df.groupBy(FILE).agg((F.max(PLACE) + 1).alias("_rows"))
    before = Window.orderBy(F.length(FILE), FILE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    files = files.select(FILE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # Sent to all tasks: dealt by file, all rows of a file would meet in one of them.
    return df.join(F.broadcast(files), FILE).withColumn(name, F.col("_before") + F.col(PLACE)).drop(FILE, PLACE, "_before")


def bind_columns(left: DataFrame, right: DataFrame, row: str | None = None) -> DataFrame:
    """Row i of ``left`` beside row i of ``right``; both come from ``in_file_order`` or ``written_order``.

    Tables of unequal length and equal column names are a ValueError. ``row`` keeps the
    row number under that name.
    """
    names = [c for c in (*left.columns, *right.columns) if c not in (FILE, PLACE)]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise ValueError(f"both tables have {', '.join(twice)}")
    sizes = [df.agg(F.count("*")).first()[0] for df in (left, right)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"cannot bind {sizes[0]} rows to {sizes[1]}")
    # Dealt by row number whatever the files' size says: it is that of compressed rows.
    both = number_rows(left, "_row").join(number_rows(right, "_row").hint("merge"), "_row")
    return both.select(*names, *([F.col("_row").alias(row)] if row else []))
