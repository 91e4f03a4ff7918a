import pytest
from checks import rows

from panelspark.operators import reshape


def long(spark):
    return spark.createDataFrame(
        [(1, 1, 5.0, "a"), (1, 3, None, "c"), (2, 2, 7.0, None)], "id int, n_vis int, cesd_tot double, m string"
    )


def test_names_split_at_the_last_underscore():
    assert reshape.split_name("cesd_tot_12") == ("cesd_tot", "12")
    with pytest.raises(ValueError):
        reshape.split_name("age")


def test_every_visit_gets_its_columns(spark):
    wide = reshape.pivot_visits(long(spark), ["cesd_tot", "m"])
    assert wide.columns == ["id", "cesd_tot_1", "cesd_tot_2", "cesd_tot_3", "m_1", "m_2", "m_3"]
    assert rows(wide) == [(1, 5.0, None, None, "a", None, "c"), (2, None, 7.0, None, None, None, None)]


def test_there_and_back(spark):
    wide = reshape.pivot_visits(long(spark), ["cesd_tot", "m"])
    many = reshape.unpivot_many(wide)
    assert many.count() == 6
    kept = reshape.observed_cells(long(spark).select("id", "n_vis"), many)
    assert rows(kept, "id", "n_vis", "cesd_tot", "m") == rows(long(spark), "id", "n_vis", "cesd_tot", "m")
    single = reshape.unpivot_measure(wide, "cesd_tot")
    assert rows(single) == rows(many.select("id", "n_vis", "cesd_tot"))


def test_prefix_of_another_measure_is_no_cell(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0)], "id int, gfr_1 double, gfr_aa_1 double")
    assert rows(reshape.unpivot_measure(wide, "gfr")) == [(1, 1, 1.0)]


def test_uneven_measures(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0, "x")], "id int, a_1 double, a_2 double, b_2 string")
    assert rows(reshape.unpivot_many(wide)) == [(1, 1, 1.0, None), (1, 2, 2.0, "x")]


def test_empty_table_keeps_its_key(spark):
    assert reshape.pivot_visits(long(spark).limit(0), ["m"]).columns == ["id"]
