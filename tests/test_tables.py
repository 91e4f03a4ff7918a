import datetime as dt

import pytest
from checks import rows
from pyspark.sql import functions as F

from panelspark.operators.panel import visit_number
from panelspark.sources import tables
from panelspark.sources.views import visits

DDL = "id long, d date, x double, flag boolean, name string"


@pytest.fixture()
def sample(spark):
    return spark.createDataFrame(
        [(1, dt.date(2008, 2, 29), 1.5, True, "a"), (2, None, None, None, None), (3, dt.date(2010, 1, 1), -2.0, False, "b, c")], DDL
    )


def test_csv_roundtrip(spark, sample, tmp_path):
    path = str(tmp_path / "t.csv")
    tables.write_table(sample, path, "csv", order=["id"])
    text = "".join(p.read_text() for p in (tmp_path / "t.csv").glob("part-*.csv"))
    assert "NA,NA,NA,NA" in text and "TRUE" in text and "FALSE" in text
    assert rows(tables.read_table(spark, path, sample.schema, "csv")) == rows(sample)


def test_csv_written_elsewhere(spark, sample, tmp_path):
    (tmp_path / "t.csv").write_text("id,d,x,flag,name\n1,2008-02-29,,TRUE,NA\n2,NA,NA,,\n")
    got = tables.read_table(spark, str(tmp_path / "t.csv"), sample.schema, "csv")
    assert rows(got) == [(1, dt.date(2008, 2, 29), None, True, None), (2, None, None, None, None)]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("extra,flag,d,name,id,x\nz,TRUE,2008-02-29,a,1.0,2\n,FALSE,NA,NA,2,NA\n")
    schema = spark.createDataFrame([], DDL).schema
    got = tables.read_table(spark, str(tmp_path / "t.csv"), schema, "csv")
    assert rows(got) == [(1, dt.date(2008, 2, 29), 2.0, True, "a"), (2, None, None, False, None)]


def test_csv_without_a_column_is_an_error(spark, sample, tmp_path):
    (tmp_path / "t.csv").write_text("id,d,x,name\n1,NA,NA,NA\n")
    with pytest.raises(ValueError, match="flag"):
        tables.read_table(spark, str(tmp_path / "t.csv"), sample.schema, "csv")


@pytest.mark.parametrize("row", ["x,NA,NA,NA,NA", "1.5,NA,NA,NA,NA", "1,2008-13-01,NA,NA,NA", "1,NA,high,NA,NA", "1,NA,NA,perhaps,NA"])
def test_csv_cells_that_do_not_fit_stop_the_job(spark, sample, tmp_path, row):
    (tmp_path / "t.csv").write_text(f"id,d,x,flag,name\n{row}\n")
    with pytest.raises(Exception, match="cannot hold"):
        tables.read_table(spark, str(tmp_path / "t.csv"), sample.schema, "csv").collect()


def test_csv_needs_a_schema(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.csv", fmt="csv")


def test_stage_roundtrip(sample, tmp_path):
    staged = tables.stage(sample, str(tmp_path), "s")
    assert staged.dtypes == sample.dtypes and rows(staged) == rows(sample)


def test_bucketed_stage_needs_no_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        source = visits(spark, "/root/testdata/sf0.001")
        staged = tables.stage(source, str(tmp_path), "v", buckets=4)
        numbered = visit_number(staged)
        both = numbered.join(staged.select("id", "visdate", F.col("lab1").alias("again")), ["id", "visdate"], "left")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert both.count() == source.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_schemas_name_no_column_twice():
    for schema in tables.RAW_SCHEMAS.values():
        assert len(set(schema.names)) == len(schema.names)


def test_csv_cells_that_do_not_fit_are_listed(spark, sample, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("name,id,d,x,flag\na,1,2008-02-29,2,TRUE\nb,x,2008-02-30,1.5,FALSE\nNA,2.0,NA,NA,NA\n")
    (tmp_path / "in" / "b.csv").write_text("name,id,d,x,flag\nc,3,2010-01-01,high,perhaps\nd,9,2010-01-02,7,TRUE\n")
    table, rejects = tables.read_csv_checked(spark, str(tmp_path / "in"), sample.schema, str(tmp_path / "out"), "t")
    assert table.schema.names == sample.schema.names
    assert rows(table) == [
        (1, dt.date(2008, 2, 29), 2.0, True, "a"), (2, None, None, None, None), (3, dt.date(2010, 1, 1), None, None, "c"),
        (9, dt.date(2010, 1, 2), 7.0, True, "d"), (None, None, 1.5, False, "b"),
    ]
    got = rejects.collect()
    assert sorted((r.file[-5:], r.column, r.text) for r in got) == [
        ("a.csv", "d", "2008-02-30"), ("a.csv", "id", "x"), ("b.csv", "flag", "perhaps"), ("b.csv", "x", "high"),
    ]
    assert len({r.row for r in got}) == 2  # two cells of each bad row
    more = (spark, str(tmp_path / "in"), sample.schema, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="d 1, flag 1, id 1, x 1"):
        tables.read_csv_checked(*more, "u", max_rejects=3)
    assert tables.read_csv_checked(*more, "v", max_rejects=4)[0].count() == 5
