"""Imputed tables and first cancers -> condition flags and their count per visit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import as_flag, strict_sum
from panelspark.operators.keys import join_on, star_join
from panelspark.operators.panel import absorbing, mark_confirmed
from panelspark.operators.registry import first_event, on_or_before

ON = ["id", "n_vis", "visdate"]
SIDES = ["hbp", "diab", "lung", "renal", "liver", "dep"]

# Measure flagged -> marker of its confirmed episode.
CONFIRMED = {
    "diab_idx": "hi_hba1c",
    "hbp_idx": "hi_bp",
    "lung_idx": "poor_lung_func",
    "renal_idx": "renal_dysfunc",
    "liver_idx": "fibrosis",
    "dep_idx": "cesd23",
}
# Condition -> what switches it on for good.
CONDITIONS = {
    "diabetes": ["diab_idx", "diabtx6m"],
    "hypertension": ["hbp_idx", "hbptx6m"],
    "lung_disease": ["lung_idx"],
    "renal_disease": ["renal_idx"],
    "depression": ["dep_idx", "deptx6m"],
    "liver_disease": ["liver_idx"],
}
# Conditions that count, and those kept apart.
COUNTED = [
    "hypertension", "diabetes", "lung_disease", "renal_disease", "liver_disease", "depression",
    "cancer", "hiv",
]
LEFT_OUT = [
    "yr", "bpsys", "bpdias", "hba1c", "fev_fvc", "gfr", "uprt_crt", "fbscan", *CONFIRMED, "dx_date",
]


def measure_flags() -> dict:
    """Elevated or abnormal measures; fixed values are the clinical cut-offs."""
    return {
        "hi_hba1c": as_flag(F.col("hba1c") > 6.5),
        "poor_lung_func": as_flag(F.col("fev_fvc") <= 0.70),
        "renal_dysfunc": as_flag((F.col("uprt_crt") > 200) | (F.col("gfr") < 60)),
        "fibrosis": as_flag(F.col("fbscan") >= 9.3),
        "cirrhosis": as_flag(F.col("fbscan") >= 12.3),
        "hi_bp": as_flag((F.col("bpdias") >= 90) | (F.col("bpsys") >= 140)),
        "cancer": on_or_before("dx_date", "visdate"),
        "cesd23": as_flag(F.col("cesdtot") >= 23),
    }


def combine(
    tables: Mapping[str, DataFrame], skip_nulls: bool = False, keep_all: bool = False
) -> DataFrame:
    """Visits with disease flags, ever-conditions and ``n_cond``.

    ``tables`` holds the imputed covariates as ``use``, one imputed table per
    entry of ``SIDES`` and ``cancer``. All windows and joins run on one
    partitioning by person. ``keep_all`` leaves the working columns in.
    """
    visits = star_join(tables["use"], [tables[s].select(*ON, *_measures(tables[s])) for s in SIDES], ON)
    visits = join_on(visits, first_event(tables["cancer"], "dx_date"), "id")
    visits = mark_confirmed(visits.withColumns(measure_flags()), CONFIRMED)
    visits = absorbing(visits, CONDITIONS, skip_nulls=skip_nulls)
    visits = visits.withColumn("n_cond", strict_sum(COUNTED))
    return visits if keep_all else visits.drop(*LEFT_OUT)


def _measures(side: DataFrame) -> list[str]:
    return [c for c in side.columns if c not in ON]
