"""Queries on registry records."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.book import query, step
from panelspark.functions import look_up, null_if, parse_year
from panelspark.operators import positions
from panelspark.operators import registry as reg
from panelspark.operators.keys import join_on
from panelspark.plans import registry as rules_
from panelspark.sources import views

SITES = {"LARGE": "Lung", "SMALL": "Colon", "MEDIUM": "Breast", "PROMO": "Prostate"}
# Prognosis sites named like the registry kinds, to join on.
KIND_SITES = {k: k for k in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}
STAGE_NAMES = {"Localized": "localized", "Distant": "distant"}


def staged(spark, sf_dir):
    """Dated records with their stage; system a also fills gaps of system b."""
    dated = reg.dated_records(views.registry(spark, sf_dir), "dx_date")
    return reg.with_stage(
        dated.withColumn("kind", null_if("kind", "NA")), "stage_a", ["stage_b", "stage_a"]
    )


step(
    "staged",
    """
SELECT rec, ln, id, dx_date, kind, tx1, tx2,
       CASE WHEN a = 0 OR b = 0 THEN 'in situ'
            WHEN a = 1 OR b = 1 THEN 'localized'
            WHEN a <= 5 OR b <= 5 THEN 'regional'
            WHEN a = 7 OR b = 7 THEN 'distant'
            WHEN a = 8 OR b = 8 THEN 'benign'
            WHEN a = 9 OR b = 9 THEN 'unknown' END AS stage
FROM (SELECT *, coalesce(raw_a, 99) AS a, coalesce(raw_b, raw_a, 99) AS b
      FROM (SELECT rec, ln, id, CAST(dx_date AS DATE) AS dx_date, nullif(kind, 'NA') AS kind, tx1, tx2,
                   TRY_CAST(stage_a AS DOUBLE) AS raw_a, TRY_CAST(stage_b AS DOUBLE) AS raw_b
            FROM registry WHERE dx_date <> 'NA'))""",
    "registry",
)
step(
    "treated",
    """
SELECT *, TRY_CAST(substr(tx1, 1, 4) AS INT) AS yr1, TRY_CAST(substr(tx2, 1, 4) AS INT) AS yr2
FROM staged""",
    "staged",
)


@query("registry_stage", "SELECT rec, ln, id, dx_date, kind, stage FROM staged", "staged")
def registry_stage(spark, sf_dir):
    return staged(spark, sf_dir).select("rec", "ln", "id", "dx_date", "kind", "stage")


@query(
    "first_treatment_year",
    "SELECT rec, ln, least(yr1, yr2) AS yr_first_trt, yr1, yr2 FROM treated",
    "treated",
)
def first_treatment_year(spark, sf_dir):
    return reg.dated_records(views.registry(spark, sf_dir), "dx_date").select(
        "rec",
        "ln",
        reg.first_year(["tx1", "tx2"]).alias("yr_first_trt"),
        parse_year("tx1").alias("yr1"),
        parse_year("tx2").alias("yr2"),
    )


def treated(spark, sf_dir):
    """Stage and treatment columns of the same record, in one projection."""
    return staged(spark, sf_dir).select(
        "rec",
        "ln",
        "id",
        "dx_date",
        "kind",
        "stage",
        reg.first_year(["tx1", "tx2"]).alias("yr_first_trt"),
        parse_year("tx1").alias("yr1"),
        parse_year("tx2").alias("yr2"),
    )


@query(
    "registry_treatment_bind",
    """
SELECT rec, ln, id, dx_date, kind, stage, least(yr1, yr2) AS yr_first_trt, yr1, yr2
FROM treated""",
    "treated",
)
def registry_treatment_bind(spark, sf_dir):
    return treated(spark, sf_dir)


@query(
    "rule_cascade",
    """
SELECT rec, ln, kind, stage, yr1, yr2, nullif(outcome, 99) AS std_trt
FROM (SELECT *, CASE
        WHEN kind IN ('LARGE', 'ECONOMY') AND yr1 IS NOT NULL AND yr2 IS NOT NULL THEN 1
        WHEN kind = 'SMALL' AND yr2 IS NOT NULL THEN 1
        WHEN kind = 'PROMO' OR stage = 'unknown' THEN 99
        WHEN stage = 'distant' THEN 0
        WHEN stage = 'benign' THEN 1
        WHEN kind = 'STANDARD' AND stage = 'localized' AND yr1 IS NOT NULL THEN 1
        WHEN kind = 'STANDARD' AND stage = 'regional' AND (yr1 IS NOT NULL OR yr2 IS NOT NULL) THEN 1
        WHEN kind = 'MEDIUM' AND stage = 'local' AND yr1 IS NOT NULL THEN 1
        WHEN kind = 'MEDIUM' AND yr2 IS NOT NULL THEN 1
        WHEN kind = 'LARGE' AND stage = 'in situ' THEN 1
        WHEN kind = 'ECONOMY' AND yr1 IS NULL AND yr2 IS NULL THEN 1
        WHEN kind = 'ECONOMY' AND stage = 'regional' AND yr2 IS NOT NULL THEN 1
        ELSE 0 END AS outcome FROM treated)""",
    "treated",
)
def rule_cascade(spark, sf_dir):
    kind, stage = F.col("kind"), F.col("stage")
    has1, has2 = F.col("yr1").isNotNull(), F.col("yr2").isNotNull()
    rules = [
        (kind.isin("LARGE", "ECONOMY") & has1 & has2, 1),
        ((kind == "SMALL") & has2, 1),
        ((kind == "PROMO") | (stage == "unknown"), None),
        (stage == "distant", 0),
        (stage == "benign", 1),
        ((kind == "STANDARD") & (stage == "localized") & has1, 1),
        ((kind == "STANDARD") & (stage == "regional") & (has1 | has2), 1),
        # No record is staged "local", so this rule never fires.
        ((kind == "MEDIUM") & (stage == "local") & has1, 1),
        ((kind == "MEDIUM") & has2, 1),
        ((kind == "LARGE") & (stage == "in situ"), 1),
        ((kind == "ECONOMY") & ~has1 & ~has2, 1),
        ((kind == "ECONOMY") & (stage == "regional") & has2, 1),
    ]
    return treated(spark, sf_dir).select(
        "rec", "ln", "kind", "stage", "yr1", "yr2", reg.rule_outcome(rules).alias("std_trt")
    )


@query(
    "code_lookup",
    """
SELECT rec, ln, kind,
       CASE kind WHEN 'LARGE' THEN 'Lung' WHEN 'SMALL' THEN 'Colon'
                 WHEN 'MEDIUM' THEN 'Breast' WHEN 'PROMO' THEN 'Prostate' END AS site
FROM registry""",
    "registry",
)
def code_lookup(spark, sf_dir):
    return views.registry(spark, sf_dir).select("rec", "ln", "kind", look_up("kind", SITES).alias("site"))


step(
    "chosen_prognosis",
    """
SELECT site, stage, survival, n, CAST(survival < 0.52 AS INT) AS poor_prog
FROM prognosis
WHERE (stage = 'Localized' AND site NOT IN ('SMALL', 'PROMO'))
   OR (stage = 'Distant' AND site IN ('SMALL', 'PROMO'))""",
    "prognosis",
)


@query(
    "prognosis_select",
    "SELECT site, stage, round(survival, 4) AS survival, n, poor_prog FROM chosen_prognosis",
    "chosen_prognosis",
)
def prognosis_select(spark, sf_dir):
    chosen = reg.select_prognosis(
        views.prognosis(spark, sf_dir),
        {"Distant": ["SMALL", "PROMO"]},
        shared="Localized",
        stratum="stage",
        threshold=0.52,
    )
    return chosen.withColumn("survival", F.round("survival", 4))


@query(
    "registry_prognosis",
    """
SELECT s.rec, s.ln, s.id, s.kind AS site, s.stage, round(p.survival, 4) AS survival, p.n
FROM staged s
LEFT JOIN (SELECT site, CASE stage WHEN 'Localized' THEN 'localized' WHEN 'Distant' THEN 'distant'
                                   ELSE stage END AS stage, survival, n
           FROM prognosis
           UNION ALL SELECT NULL, NULL, 0.25e0, 0) p
ON s.kind IS NOT DISTINCT FROM p.site AND s.stage IS NOT DISTINCT FROM p.stage""",
    "staged",
    "prognosis",
)
def registry_prognosis(spark, sf_dir):
    # One extra row with both keys missing shows that missing keys match.
    outcome = views.prognosis(spark, sf_dir)
    blank = spark.range(1).select(
        F.lit(None).cast("string").alias("site"),
        F.lit(None).cast("string").alias("stage"),
        F.lit(0.25).alias("survival"),
        F.lit(0).cast("long").alias("n"),
    )
    records = staged(spark, sf_dir).select(
        "rec", "ln", "id", look_up("kind", KIND_SITES).alias("site"), "stage"
    )
    joined = reg.attach_prognosis(records, outcome.unionByName(blank), STAGE_NAMES)
    return joined.withColumn("survival", F.round("survival", 4))


@query(
    "prior_event_flag",
    """
SELECT v.id, v.visit, v.visdate, CASE WHEN e.dx_date IS NULL OR e.dx_date > v.visdate THEN 0 ELSE 1 END AS event
FROM visits v LEFT JOIN (SELECT id, min(dx_date) AS dx_date FROM staged GROUP BY id) e USING (id)""",
    "visits",
    "staged",
)
def prior_event_flag(spark, sf_dir):
    return with_event(views.visits(spark, sf_dir), spark, sf_dir).select("id", "visit", "visdate", "event")


def with_event(rows, spark, sf_dir):
    """Visits with the flag of a registry record dated on or before the visit."""
    dated = reg.dated_records(views.registry(spark, sf_dir), "dx_date").select("id", "dx_date")
    joined = join_on(rows, reg.first_event(dated, "dx_date"), "id")
    return joined.withColumn("event", reg.on_or_before("dx_date", "visdate")).drop("dx_date")


# Every cancer type of the real rules in turn, every stage in turn, treatments by the record's numbers.
KINDS = sorted({k for _, kinds in rules_.STANDARD_CARE for k in kinds} | {*rules_.BLOOD_CANCERS, *rules_.SITES} | {"otherilldefined", "othfemgen"})
STAGES = ["localized", "regional", "distant", "unknown", "benign", "local", "in situ"]
GIVEN = {"surg": 2, "rad": 3, "chemo": 5}


def _care_sql() -> str:
    def received(care) -> str:
        parts = [f"yr_{t} IS NOT NULL" for t in care.all_of]
        if care.any_of:
            parts.append("(" + " OR ".join(f"yr_{t} IS NOT NULL" for t in care.any_of) + ")")
        return " AND ".join(parts) or "TRUE"

    def names(kinds) -> str:
        return ", ".join(f"'{k}'" for k in kinds)

    rows = [
        f"WHEN cancer_type IN ({names(rules_.BLOOD_CANCERS)}) AND yr_chemo IS NOT NULL THEN 1",
        "WHEN cancer_type = 'otherilldefined' OR stage = 'unknown' THEN NULL",
        "WHEN stage = 'distant' THEN 0",
        "WHEN stage = 'benign' THEN 1",
        *[f"WHEN cancer_type IN ({names(kinds)}) AND {received(care)} THEN 1" for care, kinds in rules_.STANDARD_CARE],
        *[
            f"WHEN cancer_type = '{kind}' AND stage = '{stage}' AND {received(care)} THEN 1"
            for kind, stage, care in rules_.STAGED_CARE
        ],
    ]
    sites = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in rules_.SITES.items())
    pick = lambda values, key: f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    return f"""
SELECT rec, ln, cancer_type, stage, CASE {' '.join(rows)} ELSE 0 END AS std_trt,
       CASE WHEN cancer_type IN ({names(rules_.WITHOUT_SITE)}) THEN '{rules_.NO_SITE}'
            ELSE CASE cancer_type {sites} END END AS site
FROM (SELECT l_orderkey AS rec, l_linenumber AS ln,
             {pick(KINDS, f"(l_orderkey + l_linenumber) % {len(KINDS)}")} AS cancer_type,
             {pick(STAGES, f"l_partkey % {len(STAGES)}")} AS stage,
             {', '.join(f"CASE WHEN l_suppkey % {m} <> 0 THEN 2000 END AS yr_{t}" for t, m in GIVEN.items())}
      FROM lineitem) r"""


@query("care_rules", _care_sql())
def care_rules(spark, sf_dir):
    """The real rule and site tables on records that run through all of their names."""
    def pick(values, key):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))

    lines = views.table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_orderkey").alias("rec"),
        F.col("l_linenumber").alias("ln"),
        pick(KINDS, F.col("l_orderkey") + F.col("l_linenumber")).alias("cancer_type"),
        pick(STAGES, F.col("l_partkey")).alias("stage"),
        *[F.when(F.col("l_suppkey") % m != 0, F.lit(2000)).alias(f"yr_{t}") for t, m in GIVEN.items()],
    )
    return rows.select("rec", "ln", "cancer_type", "stage", rules_.standard_care().alias("std_trt"), rules_.site_of().alias("site"))


@query(
    "positional_bind",
    "SELECT l_orderkey AS rec, l_linenumber AS ln, CAST(l_shipdate AS DATE) AS shipped, l_returnflag AS flag FROM lineitem",
)
def positional_bind(spark, sf_dir):
    """Two extracts of one table, read on their own, bound again row by row."""
    path = f"{sf_dir}/lineitem.parquet"
    names = positions.in_file_order(spark, path, ["l_orderkey", "l_linenumber"])
    facts = positions.in_file_order(spark, path, ["l_shipdate", "l_returnflag"])
    both = positions.bind_columns(names, facts)
    return both.select(
        F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("ln"), F.col("l_shipdate").cast("date").alias("shipped"),
        F.col("l_returnflag").alias("flag"),
    )
