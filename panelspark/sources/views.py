"""Cohort-shaped views over the order tables.

A customer plays the person, an order the visit, and a lineitem with its part a
registry record. Missing values are placed by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import year_range
from panelspark.operators.keys import collapse
from panelspark.sources.tables import RAW_SCHEMAS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_mktsegment").alias("segment"),
        (key % 2).cast("int").alias("sex01"),
        F.when(key % 11 != 0, F.col("c_nationkey") % 2).alias("grp01"),
        F.col("c_acctbal").alias("score"),
        (key % 36 + 1985).cast("int").alias("yr_enroll"),
    )


def raw_visits(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """One row per order; a person may have several on one day.

    ``years`` limits the calendar years on the stored column, so that the scan
    skips what lies outside.
    """
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    priority = F.col("o_orderpriority")
    orders = table(spark, sf_dir, "orders")
    if years:
        orders = orders.filter(year_range("o_orderdate", *years))
    return orders.select(
        F.col("o_custkey").alias("id"),
        key.alias("visit"),
        F.col("o_orderdate").cast("date").alias("visdate"),
        F.when(key % 7 != 0, price).alias("lab1"),
        F.when(key % 5 != 0, price * 2).alias("lab2"),
        F.when(key % 3 != 0, (key % 60).cast("double")).alias("lab3"),
        F.when(priority == "1-URGENT", 1).when(priority != "4-NOT SPECIFIED", 0).alias("dx"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("tx"),
        F.when(key % 13 != 0, (key % 2).cast("int")).alias("used"),
    )


def visits(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """One row per (person, date): the first order of the day.

    Same-day repeats are combined before the shuffle, so no person can bring
    more rows into a task than there are days.
    """
    return collapse(raw_visits(spark, sf_dir, years), ["id", "visdate"], "visit")


def death_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vital status per person: flag and date as text without separators."""
    key = F.col("c_custkey")
    day = F.date_add(F.lit("1999-01-01").cast("date"), (key % 1095).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        (F.col("c_acctbal") < 0).cast("int").alias("dead"),
        F.date_format(day, "yyyyMMdd").alias("dod_text"),
    )


def deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deceased persons with their date of death."""
    key = F.col("c_custkey")
    day = F.date_add(F.lit("1999-01-01").cast("date"), (key % 1095).cast("int"))
    return (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_acctbal") < 0)
        .select(key.alias("id"), day.alias("dod"))
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry records as text, missing values as the string ``NA``."""
    order, part, ship = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_shipdate").cast("date")

    def text(cond, value):
        return F.when(cond, "NA").otherwise(value.cast("string"))

    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    persons = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return lines.join(persons, lines.l_orderkey == persons.o_orderkey).select(
        order.alias("rec"),
        F.col("l_linenumber").alias("ln"),
        F.col("o_custkey").alias("id"),
        text(F.col("l_linenumber") == 7, ship).alias("dx_date"),
        text(order % 9 == 0, F.col("p_type")).alias("kind"),
        text(order % 4 == 0, order % 10).alias("stage_a"),
        text(order % 3 == 0, part % 10).alias("stage_b"),
        text(F.col("l_returnflag") == "A", F.year(ship)).alias("tx1"),
        text(F.col("l_linestatus") == "F", F.year(ship) + 1).alias("tx2"),
    )


def prognosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean outcome per site and stage."""
    stage = F.when(F.col("p_brand") < "Brand#2", "Localized").otherwise("Distant")
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("site"), stage.alias("stage"))
        .agg(F.avg(F.col("p_size") / F.lit(50.0)).alias("survival"), F.count("*").alias("n"))
    )


def study_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw study visits with every declared column, one row per order; values by rule.

    Column j holds (order + j) % 2, and nothing where (order + j) % 5 is 0; numbers are
    (order + j) % 97 / 2.
    """
    key = F.col("o_orderkey")
    columns = []
    for j, field in enumerate(RAW_SCHEMAS["visit_raw"]):
        if field.name == "id":
            value = F.col("o_custkey")
        elif field.name == "visit":
            value = key
        elif field.name == "visdate":
            value = F.col("o_orderdate")
        elif field.dataType.simpleString() == "double":
            value = F.when((key + j) % 5 != 0, (key + j) % 97 / 2)
        else:
            value = F.when((key + j) % 5 != 0, (key + j) % 2)
        columns.append(value.cast(field.dataType).alias(field.name))
    return table(spark, sf_dir, "orders").select(*columns)


def enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person with the day of enrolment."""
    key = F.col("c_custkey")
    day = F.date_add(F.lit("1988-01-01").cast("date"), (key % 11000).cast("int"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), day.alias("basdate"))
