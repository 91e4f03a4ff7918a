"""A study that failed goes on with the stages that are whole."""

import pytest
from checks import rows
from pyspark.sql import functions as F
from study_data import raw_tables

from panelspark.plans import study
from panelspark.sources.stages import Stages, fingerprint


@pytest.fixture()
def raw(spark):
    return {name: df.cache() for name, df in raw_tables(spark, persons=30, visits=8).items()}


@pytest.fixture()
def calls(monkeypatch):
    """Measures as they are instead of imputed ones: what is counted here is which stages run."""
    made = []

    def condition(tables, name, layout, **settings):
        made.append(name)
        return study_imputation.visit_table(tables, study_imputation.CONDITIONS[name]).select(
            "id", "visdate", "n_vis", *study_imputation.CONDITIONS[name].outputs
        )

    def covariates(tables, layout, **settings):
        made.append("use")
        part = study_imputation
        visits = part.with_person(part.visit_table(tables, None), part.person_table(tables))
        return visits.select("id", "visdate", "n_vis", *part.PERSON, *part.SOCDEM, *part.DRUG, *part.HIV, part.YEAR)

    from panelspark.plans import imputation as study_imputation

    monkeypatch.setattr(study, "impute_condition", condition)
    monkeypatch.setattr(study, "impute_covariates", covariates)
    return made


def test_a_failed_study_goes_on(spark, raw, calls, tmp_path, monkeypatch):
    want = study.run_study(raw, str(tmp_path / "whole"))
    whole, calls[:] = list(calls), []
    plain = study.combine
    monkeypatch.setattr(study, "combine", lambda tables: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        study.run_study(raw, str(tmp_path / "again"), resume=True)
    assert calls == whole
    calls.clear()
    monkeypatch.setattr(study, "combine", plain)
    # One stage is there without its manifest, as after a failure while it was written.
    Stages(spark, str(tmp_path / "again")).forget("hbp_impute")
    got = study.run_study(raw, str(tmp_path / "again"), resume=True)
    assert calls == ["hbp"]
    for name in ("use", "hbp_impute", "multimorbid_visits", "intervals", "curve", "yearly_curve"):
        assert rows(got[name]) == rows(want[name])
    calls.clear()
    study.run_study(raw, str(tmp_path / "again"), resume=True)
    assert calls == []
    # Other data: everything is made again.
    fewer = {**raw, "visit_raw": raw["visit_raw"].filter("id < 20")}
    study.run_study(fewer, str(tmp_path / "again"), resume=True)
    assert calls == whole


def test_fingerprints(spark):
    df = spark.range(50).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id")))
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("id")).repartition(3))
    assert fingerprint(df) != fingerprint(df.withColumn("x", F.coalesce("x", F.lit(-1))))
    assert fingerprint(df.limit(0))["rows"] == 0


def test_a_table_without_its_manifest_is_not_whole(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    stages.write(spark.range(5), "a", note="x")
    assert stages.facts("a")["note"] == "x" and stages.read("a").count() == 5
    stages.forget("a")
    assert stages.facts("a") is None
    stages.write(spark.range(3), "a")
    assert stages.read("a").count() == 3
    stages.drop("a")
    assert stages.facts("a") is None
