"""Cancer registry -> one row per diagnosis with stage, treatment and prognosis."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import in_set, look_up, null_if, parse_year
from panelspark.operators import registry as reg

# Treatment date fields.
TREATMENT_DATES = {
    "BRM": "MCR_RxDateBRM",
    "chemo": "MCR_RxDateChemo",
    "horm": "MCR_RxDateHorm",
    "mdsurg": "MCR_RxDateMostDefSurg",
    "oth": "MCR_RxDateOth",
    "rad": "MCR_RxDateRad",
    "surg": "MCR_RxDateSurg",
    "sys": "MCR_RxDateSystemic",
}

# Cancers for which chemotherapy is standard whatever the stage.
BLOOD_CANCERS = ("chronlymphleuk", "chronmyelleuk", "acutemyelleuk", "hodgelymph", "multmyeloma", "nonhodgelymph")



@dataclass(frozen=True)
class Care:
    """Treatments that count as standard care: all of some, or any of some; none for neither."""

    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()


# Cancers by the treatment that is standard for them.
STANDARD_CARE = (
    (Care(all_of=("rad", "chemo")), ("anus",)),
    (
        Care(all_of=("surg",)),
        (
            "insitubadder", "insitufembreast", "insitucervix", "CINgradeIII", "kidneyren", "testis", "thyroid",
            "ureter", "VAINgradeIII", "VINgradeIII",
        ),
    ),
    (Care(all_of=("chemo",)), ("skinmelan",)),
    (Care(any_of=("surg", "rad")), ("brain",)),
    (Care(any_of=("surg", "chemo")), ("cervix", "mesothelio", "othdig", "ovary")),
    (
        Care(any_of=("surg", "chemo", "rad")),
        (
            "fembreast", "malebreast", "colonnotrect", "esophagus", "gallbladder", "gumothermouth", "larynx",
            "liverandduct", "lungbronch", "oropharynx", "otherbucphar", "pancreas", "rectandsig", "smallintest",
            "softtissue", "stomach", "tongue",
        ),
    ),
    (Care(), ("AINgradeIII", "kapsarc", "otherendoc")),
)

# The same for cancers whose standard depends on the stage.
STAGED_CARE = (
    ("bladder", "local", Care(all_of=("surg",))),
    ("bladder", "regional", Care(all_of=("surg", "chemo"))),
    ("othfemgen", "local", Care(all_of=("surg",))),
    ("othfemgen", "regional", Care(any_of=("surg", "chemo", "rad"))),
    ("prostate", "local", Care(all_of=("surg",))),
    ("prostate", "regional", Care(any_of=("surg", "rad"))),
)

# Names in the lists above that no record carries, and the names
# that were meant. Applied only on request.
CORRECTIONS = {"local": "localized", "insitubadder": "insitubladder"}

# Prognosis site by cancer type.
SITES = {
    "acutemyelleuk": "Acute Myeloid Leukemia",
    "anus": "Colon and Rectum",
    "bladder": "Urinary Bladder",
    "brain": "Brain and Other Nervous System",
    "cervix": "Cervix Uteri",
    "chronlymphleuk": "Chronic Lymphocytic Leukemia",
    "chronmyelleuk": "Chronic Myeloid Leukemia",
    "colonnotrect": "Colon and Rectum",
    "rectandsig": "Colon and Rectum",
    "esophagus": "Esophagus",
    "fembreast": "Breast",
    "malebreast": "Breast",
    "gallbladder": "Gallbladder",
    "gumothermouth": "Oral Cavity and Pharynx",
    "oropharynx": "Oral Cavity and Pharynx",
    "otherbucphar": "Oral Cavity and Pharynx",
    "tongue": "Oral Cavity and Pharynx",
    "hodgelymph": "Hodgkin Lymphoma",
    "kapsarc": "Kaposi Sarcoma",
    "kidneyren": "Kidney and Renal Pelvis",
    "larynx": "Larynx",
    "liverandduct": "Liver and Intrahepatic Bile Duct",
    "lungbronch": "Lung and Bronchus",
    "mesothelio": "Mesothelioma",
    "multmyeloma": "Myeloma",
    "nonhodgelymph": "Non-Hodgkin Lymphoma",
    "ovary": "Ovary",
    "pancreas": "Pancreas",
    "prostate": "Prostate",
    "skinmelan": "Melanoma of the Skin",
    "softtissue": "Soft Tissue including Heart",
    "stomach": "Stomach",
    "testis": "Testis",
    "thyroid": "Thyroid",
}
# Cancer types without a prognosis site carry this text.
NO_SITE = "NA"
WITHOUT_SITE = """
    AINgradeIII benigncnsendo benignothnerve CINgradeIII insitubladder insitucervix insitufembreast
    VAINgradeIII VINgradeIII othdig otherendoc otherilldefined othfemgen smallintest ureter""".split()

# Prognosis rows by sex, and stage names.
BOTH_SEXES, ALL_RACES = "Male and female", "All races"
SEX_SITES = {
    "Female": ["Cervix Uteri", "Corpus and Uterus, NOS", "Ovary"],
    "Male": ["Prostate", "Testis"],
}
STAGE_NAMES = {
    "Unknown/unstaged": "unknown",
    "Localized": "localized",
    "Regional": "regional",
    "Distant": "distant",
}
POOR_SURVIVAL = 0.5


def diagnoses(registry_raw: DataFrame) -> DataFrame:
    """Dated diagnoses with stage text and treatment years."""
    staged = reg.with_stage(
        reg.dated_records(registry_raw, "MCR_DxDate"),
        ["MCR_SEERSumStg2000", "MCR_DerivedSS2000"],
        "MCR_SEERSumStg1977",
        "MCR_Summary_Stage_2018",
    )
    return staged.select(
        "id",
        F.col("MCR_DxDate").alias("dx_date"),
        null_if("MCR_cancertype", "NA").alias("cancer_type"),
        null_if("MCR_Psite", "NA").alias("psite"),
        "stage",
        reg.first_year(list(TREATMENT_DATES.values())).alias("yr_first_trt"),
        *[parse_year(TREATMENT_DATES[t]).alias(f"yr_{t}") for t in ("surg", "rad", "chemo")],
    )


def _received(care: Care) -> Column:
    """Whether the treatments of ``care`` were given."""
    out = F.lit(True)
    for t in care.all_of:
        out = out & F.col(f"yr_{t}").isNotNull()
    if care.any_of:
        out = out & reduce(lambda a, b: a | b, [F.col(f"yr_{t}").isNotNull() for t in care.any_of])
    return out


def standard_care(corrected: bool = False) -> Column:
    """1 when the standard treatment was received, 0 when not, NULL when unknown."""

    def name(text: str) -> str:
        return CORRECTIONS.get(text, text) if corrected else text

    kind, stage = F.col("cancer_type"), F.col("stage")
    rules = [
        (kind.isin(*BLOOD_CANCERS) & _received(Care(all_of=("chemo",))), 1),
        ((kind == "otherilldefined") | (stage == "unknown"), None),
        (stage == "distant", 0),
        (stage == "benign", 1),
    ]
    for care, kinds in STANDARD_CARE:
        rules.append((kind.isin(*[name(k) for k in kinds]) & _received(care), 1))
    for one, at, care in STAGED_CARE:
        rules.append(((kind == one) & (stage == name(at)) & _received(care), 1))
    return reg.rule_outcome(rules)


def site_of(cancer_type: str = "cancer_type") -> Column:
    """Prognosis site of a cancer type; types listed without one get ``NO_SITE``."""
    return F.when(in_set(cancer_type, WITHOUT_SITE), NO_SITE).otherwise(look_up(cancer_type, SITES))


def prognosis_table(prognosis_raw: DataFrame, threshold: float = POOR_SURVIVAL) -> DataFrame:
    """One row per site and stage, with the poor-prognosis flag."""
    pooled = prognosis_raw.filter(F.col("race") == ALL_RACES)
    chosen = reg.select_prognosis(pooled, SEX_SITES, BOTH_SEXES, threshold=threshold)
    return chosen.drop("sex", "race")


def registry(registry_raw: DataFrame, prognosis_raw: DataFrame, corrected: bool = False) -> DataFrame:
    """The finished cancer table."""
    records = diagnoses(registry_raw).withColumn("std_trt", standard_care(corrected))
    sited = records.withColumn("site", site_of())
    return reg.attach_prognosis(sited, prognosis_table(prognosis_raw), STAGE_NAMES)
