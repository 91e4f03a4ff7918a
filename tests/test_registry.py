import pytest
from checks import rows
from pyspark.sql import functions as F

from panelspark.operators import registry as reg
from panelspark.plans import registry as plan


@pytest.mark.parametrize(
    "a,b,stage",
    [
        ("7", "3", "regional"), ("7", "NA", "distant"), ("NA", "NA", None), ("6", "NA", None),
        ("0", "1", "in situ"), ("1", "9", "localized"), ("8", "9", "benign"), ("NA", "9", "unknown"),
        ("2", "7", "regional"),
    ],
)
def test_stage(spark, a, b, stage):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert reg.with_stage(df, "a", "b").first()["stage"] == stage


def test_a_second_field_fills_a_system(spark):
    df = spark.createDataFrame([("NA", "1"), ("7", "1")], "a string, d string")
    assert sorted(r["stage"] for r in reg.with_stage(df, ["a", "d"]).collect()) == ["distant", "localized"]


def test_records_without_a_date_drop_out(spark):
    df = spark.createDataFrame([("NA",), (None,), ("20110105",), ("bad",)], "d string")
    assert rows(reg.dated_records(df, "d").select(F.col("d").cast("string"))) == [("2011-01-05",), (None,)]


def test_first_year(spark):
    df = spark.createDataFrame([("20110105", "2009"), ("NA", "2012"), ("NA", None)], "a string, b string")
    assert rows(df.select(reg.first_year(["a", "b"]))) == [(2009,), (2012,), (None,)]


CARE = [
    # type, stage, surgery, radiation, chemo, standard care received
    ("hodgelymph", "distant", 0, 0, 1, 1),
    ("hodgelymph", "distant", 0, 0, 0, 0),
    ("otherilldefined", None, 1, 1, 1, None),
    ("prostate", "unknown", 1, 0, 0, None),
    ("prostate", "distant", 1, 1, 1, 0),
    ("prostate", "benign", 0, 0, 0, 1),
    ("prostate", "localized", 1, 0, 0, 0),
    ("prostate", "regional", 0, 1, 0, 1),
    ("anus", "regional", 0, 1, 1, 1),
    ("anus", "regional", 0, 1, 0, 0),
    ("bladder", "regional", 1, 0, 0, 0),
    ("bladder", "regional", 1, 0, 1, 1),
    ("kapsarc", None, 0, 0, 0, 1),
    ("insitubladder", "in situ", 1, 0, 0, 0),
    ("skinmelan", "localized", 1, 1, 0, 0),
    ("brain", "localized", 0, 1, 0, 1),
    ("pancreas", "regional", 0, 0, 1, 1),
    (None, None, 1, 1, 1, 0),
]


def care_rows(spark, cases):
    df = spark.createDataFrame(
        [(i, *c[:5]) for i, c in enumerate(cases)],
        "k int, cancer_type string, stage string, s int, r int, c int",
    )
    return df.select(
        "k", "cancer_type", "stage",
        *[F.when(F.col(x) == 1, 2010).alias(f"yr_{y}") for x, y in zip("src", ["surg", "rad", "chemo"])],
    )


def test_standard_care_as_written(spark):
    out = care_rows(spark, CARE).select("k", plan.standard_care())
    assert rows(out) == [(i, c[5]) for i, c in enumerate(CARE)]


def test_standard_care_corrected(spark):
    cases = [("prostate", "localized", 1, 0, 0), ("insitubladder", "in situ", 1, 0, 0)]
    assert rows(care_rows(spark, cases).select("k", plan.standard_care(corrected=True))) == [(0, 1), (1, 1)]


def test_every_type_has_a_site_or_is_listed_without(spark):
    df = spark.createDataFrame([("tongue",), ("othdig",), ("new",), (None,)], "cancer_type string")
    assert rows(df.select("cancer_type", plan.site_of())) == [
        ("new", None), ("othdig", "NA"), ("tongue", "Oral Cavity and Pharynx"), (None, None),
    ]


def test_prognosis_takes_the_stratum_of_the_site(spark):
    data = [
        ("Ovary", "Localized", "Female", "All races", 0.9), ("Ovary", "Localized", "Male and female", "All races", 0.1),
        ("Larynx", "Distant", "Male and female", "All races", 0.3), ("Larynx", "Distant", "Male", "All races", 0.9),
        ("Testis", "Regional", "Male", "All races", 0.5), ("Testis", "Regional", "Male", "White", 0.4),
        ("Larynx", "Regional", "Male and female", "All races", None),
    ]
    df = spark.createDataFrame(data, "site string, stage string, sex string, race string, survival double")
    assert rows(plan.prognosis_table(df)) == [
        ("Larynx", "Distant", 0.3, 1), ("Larynx", "Regional", None, None),
        ("Ovary", "Localized", 0.9, 0), ("Testis", "Regional", 0.5, 0),
    ]


def test_event_on_or_before(spark):
    df = spark.createDataFrame([(1, 5), (5, 5), (6, 5), (None, 5)], "e int, d int")
    assert rows(df.select("e", reg.on_or_before("e", "d"))) == [(1, 1), (5, 1), (6, 0), (None, 0)]
