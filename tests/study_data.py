"""Raw study tables built by rule: a person is an id, a visit an (id, number) pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.sources.tables import RAW_SCHEMAS, VISIT_COLUMNS


def draw(name: str, n: int):
    """Number 0..n-1 fixed by person, visit and ``name``."""
    return F.pmod(F.xxhash64("id", "visit", F.lit(name)), F.lit(n))


NUMBERS = {
    "age": (30, 40), "fev_fvc": (50, 45), "hba1c": (45, 40), "bpdias": (60, 50), "bpsys": (100, 70),
    "gfr_aa": (40, 70), "gfr_naa": (40, 70), "uprt_crt": (20, 300), "fbscan": (3, 14), "cesdtot": (0, 45),
}


def raw_tables(spark, persons: int = 60, visits: int = 14) -> dict:
    grid = spark.range(persons * visits).select(
        (F.col("id") / visits).cast("long").alias("id"), (F.col("id") % visits).cast("int").alias("visit")
    )
    start = F.date_add(F.lit("2006-06-01").cast("date"), (F.col("id") % 500).cast("int"))
    step = F.when(F.col("id") % 5 == 0, 290).otherwise(170) + draw("step", 60)
    grid = grid.withColumn("visdate", F.date_add(start, (F.col("visit") * step).cast("int")))
    columns = []
    for field in RAW_SCHEMAS["visit_raw"]:
        name = field.name
        if name in ("id", "visit", "visdate"):
            columns.append(F.col(name))
            continue
        if name in ("m0f1", "black", "beduchs"):
            value = F.pmod(F.xxhash64("id", F.lit(name)), F.lit(2))
        elif name in NUMBERS:
            low, width = NUMBERS[name]
            scale = 100.0 if name == "fev_fvc" else 10.0 if name == "hba1c" else 1.0
            value = (low + draw(name, width)) / scale
        else:
            value = (draw(name, 10) < 3).cast("int")
        gap = draw(f"{name}?", 10) == 0 if name != "age" else F.lit(False)
        columns.append(F.when(~gap, value).cast(field.dataType).alias(name))
    ids = spark.range(persons).withColumn("visit", F.lit(0))
    text = F.date_format(F.date_add(F.lit("2011-01-01").cast("date"), (F.col("id") * 40).cast("int")), "yyyyMMdd")
    kinds = F.array(*[F.lit(k) for k in ["lungbronch", "prostate", "bladder", "hodgelymph", "NA", "othdig", "ovary"]])

    def year_or_na(name):
        return F.when(draw(name, 3) == 0, "NA").otherwise(F.concat((F.lit(2009) + draw(name, 6)).cast("string"), F.lit("0101")))

    registry = ids.filter("id % 3 = 0").select(
        "id",
        F.when(F.col("id") % 9 == 0, "NA").otherwise(text).alias("MCR_DxDate"),
        F.get(kinds, (F.col("id") % 7).cast("int")).alias("MCR_cancertype"),
        F.lit("C00").alias("MCR_Psite"),
        *[
            F.when(draw(c, 2) == 0, "NA").otherwise(draw(c, 9).cast("string")).alias(c)
            for c in RAW_SCHEMAS["registry_raw"].names[4:8]
        ],
        *[year_or_na(c).alias(c) for c in RAW_SCHEMAS["registry_raw"].names[8:]],
    )
    prognosis = spark.createDataFrame(
        [
            (site, stage, sex, race, value)
            for site, value in [("Lung and Bronchus", 0.2), ("Prostate", 0.97), ("Ovary", 0.49), ("Urinary Bladder", 0.7)]
            for stage in ["Localized", "Regional", "Distant", "Unknown/unstaged"]
            for sex in ["Male", "Female", "Male and female"]
            for race in ["All races", "White"]
        ],
        RAW_SCHEMAS["prognosis_raw"],
    )
    return {
        "visit_raw": grid.select(*columns),
        "enroll_raw": ids.select(
            "id", F.date_add(F.lit("1988-01-01").cast("date"), (F.col("id") * 180).cast("int")).alias("basdate")
        ),
        "death_raw": ids.select(
            "id", F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("dead20f"), text.alias("dthdate20f")
        ),
        "registry_raw": registry,
        "prognosis_raw": prognosis,
    }


assert set(NUMBERS) <= set(VISIT_COLUMNS["double"].split())
