"""Raw visit, enrolment and death tables -> one table per domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import (
    any_equal,
    days_between,
    parse_ymd,
    right_closed_bins,
    strict_if,
    years_between,
)
from panelspark.operators.keys import first_per_key, join_on, repeated_keys

# Enrolment periods, right-closed year bins.
PERIOD_BREAKS = [1987, 1992, 1997, 2001, 2015, 2018]
PERIODS = ["1988-1992", "1994-1997", "1998-2001", "2005-2015", "2016-2018"]

KEYS = ["id", "visit", "visdate", "enroll_period"]

# Columns of each domain table after the keys.
DOMAINS = {
    "base": "bcurrpa beduc beduchs bempcurr bevalc bevcig beverwk bevinj bhome1yr bincome bnevmar",
    "socdem": "age m0f1 race black anyhomels inclt5k work",
    "comorbid": """
        bmimedh lungdx6m lungtx6m copd fev_fvc maxfev maxfvc evrlungdx
        diabdx6m diabtx6m hba1c evrdiab hbpdx6m hbptx6m bpdias bpsys evrhbp
        hcholdx6m hcholtx6m evrhchol hrtpbdx6m hrtpbtx6m evrhrtpb
        renaldx6m renaltx6m gfr ucreat uprotn uprt_crt evrrenal
        strkedx6m strketx6m evrstrke seizrdx6m seizrtx6m evrseizr
        fbscan fbscgrp fbscge12_3 hemo""",
    "mental": """
        cesd23 cesdtot anxdx6m anxtx6m emedanx depdx6m deptx6m emeddep
        manddx6m mandtx6m emedmand schidx6m schitx6m emedschi ehspmntl""",
    "hiv": "hiv hivvl hrt6m hcvvis",
    "care": """
        primcare samedoc samedoc2 intrfsoc er6m inpat6m outpat6m outer6m ivamed6m
        insur6m ihmo6m imcaid6m imcaidexpd imcare6m iother6m ipriv6m irwhite""",
    "drug": """
        acdrgtx prscrbbup prscrbmeth alcheavy alcmoderate auditcat audittot auditgrp cigyn cigpack
        curuser ivstat injcoc injher injothdrg injpainklr crystali spdbal
        anntivwomj crack crystal mj smkher snrtcoc snrther benzost buprest clonist hallucgnntdoc
        methst oxycost painkilrntdoc percost sedativntdoc stimultntdoc tranqulntdoc
        drgtrt drg_nonidu""",
    "qual": "gnbdypn gnhlthst mosphs mosmhs jailge7d",
}

# What counts as drug treatment, and as use without injection.
DRUG_TREATMENT = ["acdrgtx", "prscrbbup", "prscrbmeth"]
NON_INJECTED = """
    anntivwomj crack crystal mj smkher snrtcoc snrther benzost buprest clonist hallucgnntdoc methst
    oxycost painkilrntdoc percost sedativntdoc stimultntdoc tranqulntdoc""".split()


def enriched_visits(visit_raw: DataFrame, enroll_raw: DataFrame) -> DataFrame:
    """Visits, one per person and day, with study time and derived indicators.

    Of several rows of one day the one with the lowest visit number is kept, of equal
    numbers the one a hash of all columns puts first; ``same_day_visits`` lists what
    was left out. A person enrolled twice is an error: it would double the visits.
    """
    visits = first_per_key(visit_raw, ["id", "visdate"], ["visit", F.xxhash64(*visit_raw.columns)])
    out = join_on(visits, enroll_raw.select("id", "basdate"), "id", expect="one")
    treated = F.lit(False)
    for c in DRUG_TREATMENT:
        treated = treated | (F.col(c) == 1)
    return out.withColumn("yr_enroll", F.year("basdate")).withColumns(
        {
            "days_study": days_between("basdate", "visdate"),
            "yrs_study": years_between("basdate", "visdate"),
            "enroll_period": right_closed_bins("yr_enroll", PERIOD_BREAKS, PERIODS),
            "gfr": strict_if(F.col("black") == 1, F.col("gfr_aa"), F.col("gfr_naa")),
            "drgtrt": treated,
            "drg_nonidu": any_equal(NON_INJECTED, 1),
        }
    )


def same_day_visits(visit_raw: DataFrame) -> DataFrame:
    """Person-days with more than one row, and how many rows ``enriched_visits`` leaves out."""
    return repeated_keys(visit_raw, ["id", "visdate"]).select("id", "visdate", (F.col("n") - 1).alias("n_left_out"))


def domain_table(visits: DataFrame, name: str) -> DataFrame:
    """The columns of one domain; ``base`` keeps each person's first visit only."""
    rows = visits.select(*KEYS, *DOMAINS[name].split())
    return first_per_key(rows, "id", ["visdate", "visit"]) if name == "base" else rows


def death_table(death_raw: DataFrame) -> DataFrame:
    """Date and year of death of the deceased."""
    died = death_raw.filter(F.col("dead20f") == 1).withColumn("dod", parse_ymd("dthdate20f"))
    return died.select("id", "dod", F.year("dod").alias("yod"))


def domain_tables(visits: DataFrame) -> dict[str, DataFrame]:
    """All domain tables of the enriched visits.

    They are projections; over a written ``visits`` table each reads its own
    columns only, so none needs to be written again.
    """
    return {name: domain_table(visits, name) for name in DOMAINS}
