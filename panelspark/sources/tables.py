"""Reading and writing named tables with declared schemas.

Parquet is the format between stages; CSV is for exchange with other tools, with
``NA`` or nothing for a missing value, ``TRUE`` / ``FALSE`` for booleans and ISO
dates. No schema is inferred.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import ensure_checkpoint_dir, remove_at_end

# Column types of the raw tables a study starts from. Flags are 0 / 1 / missing.
VISIT_COLUMNS = {
    "bigint": "id",
    "int": """
        visit race auditcat audittot auditgrp cigpack ivstat fbscgrp fbscge12_3 gnbdypn gnhlthst
        bcurrpa beduc beduchs bempcurr bevalc bevcig beverwk bevinj bhome1yr bincome bnevmar
        m0f1 black anyhomels inclt5k work
        bmimedh lungdx6m lungtx6m copd evrlungdx diabdx6m diabtx6m evrdiab hbpdx6m hbptx6m evrhbp
        hcholdx6m hcholtx6m evrhchol hrtpbdx6m hrtpbtx6m evrhrtpb renaldx6m renaltx6m evrrenal
        strkedx6m strketx6m evrstrke seizrdx6m seizrtx6m evrseizr
        cesd23 anxdx6m anxtx6m emedanx depdx6m deptx6m emeddep manddx6m mandtx6m emedmand
        schidx6m schitx6m emedschi ehspmntl hiv hrt6m hcvvis
        primcare samedoc samedoc2 intrfsoc er6m inpat6m outpat6m outer6m ivamed6m
        insur6m ihmo6m imcaid6m imcaidexpd imcare6m iother6m ipriv6m irwhite
        acdrgtx prscrbbup prscrbmeth alcheavy alcmoderate cigyn curuser
        injcoc injher injothdrg injpainklr crystali spdbal
        anntivwomj crack crystal mj smkher snrtcoc snrther benzost buprest clonist hallucgnntdoc
        methst oxycost painkilrntdoc percost sedativntdoc stimultntdoc tranqulntdoc jailge7d""",
    "date": "visdate",
    "double": """
        age fev_fvc maxfev maxfvc hba1c bpdias bpsys gfr_aa gfr_naa ucreat uprotn uprt_crt fbscan
        hemo cesdtot hivvl mosphs mosmhs""",
}


TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "string": T.StringType(),
}


def _schema(columns: dict[str, str]) -> T.StructType:
    return T.StructType(
        [T.StructField(n, TYPES[kind]) for kind, names in columns.items() for n in names.split()]
    )


RAW_SCHEMAS = {
    "visit_raw": _schema(VISIT_COLUMNS),
    "enroll_raw": _schema({"bigint": "id", "date": "basdate"}),
    "death_raw": _schema({"bigint": "id", "int": "dead20f", "string": "dthdate20f"}),
    "registry_raw": _schema(
        {
            "bigint": "id",
            "string": """
                MCR_DxDate MCR_cancertype MCR_Psite
                MCR_DerivedSS2000 MCR_SEERSumStg1977 MCR_SEERSumStg2000 MCR_Summary_Stage_2018
                MCR_RxDateBRM MCR_RxDateChemo MCR_RxDateHorm MCR_RxDateMostDefSurg
                MCR_RxDateOth MCR_RxDateRad MCR_RxDateSurg MCR_RxDateSystemic""",
        }
    ),
    "prognosis_raw": _schema({"string": "site stage sex race", "double": "survival"}),
}

CSV_OPTIONS = {"header": "true", "nullValue": "NA", "dateFormat": "yyyy-MM-dd"}


def _parsed(field: T.StructField) -> tuple[Column, Column, Column]:
    """A text column as its declared type, whether a cell does not fit it, and the cell's text.

    A whole number may be written with a fraction of zero (``1.0``).
    """
    text = F.trim(F.col(f"`{field.name}`"))
    if isinstance(field.dataType, T.StringType):
        return F.col(f"`{field.name}`"), F.lit(False), text
    value = text.try_cast(field.dataType)
    if isinstance(field.dataType, (T.IntegerType, T.LongType)):
        number = text.try_cast("decimal(38,6)")
        whole = F.when(number == F.floor(number), number.try_cast(field.dataType))
        value = F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), value), whole)
    return value, text.isNotNull() & value.isNull(), text


def _typed(field: T.StructField) -> Column:
    """A text column as its declared type; a cell that doesn't fit stops the job."""
    value, wrong, text = _parsed(field)
    error = F.raise_error(F.concat(F.lit(f"column {field.name} cannot hold "), text))
    return F.when(wrong, error).otherwise(value).cast(field.dataType)


def _csv_text(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """All cells of a CSV table as text; a missing column is a ValueError."""
    if schema is None:
        raise ValueError("a CSV table needs a declared schema")
    text = spark.read.options(**CSV_OPTIONS).csv(path)
    missing = [c for c in schema.names if c not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return text


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType, root: str, name: str, max_rejects: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """A CSV table with the cells that do not fit left missing, and those cells.

    The table is read once and written as Parquet below ``root`` with each row's bad cells; both
    results read from there. Rejects are rows (``file``, ``row``, ``column``, ``text``), ``row`` a
    number that is equal for the bad cells of one row and grows along a file. More of them
    than ``max_rejects`` are a ValueError that names the columns.
    """
    cells, values = [], []
    for field in schema:
        value, wrong, text = _parsed(field)
        values.append(value.cast(field.dataType).alias(field.name))
        cells.append(F.when(wrong, F.struct(F.lit(field.name).alias("column"), text.alias("text"))))
    bad = F.filter(F.array(*cells), lambda cell: cell.isNotNull())
    text = _csv_text(spark, path, schema)
    marks = [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"), bad.alias("_bad")]
    write_table(text.select(*values, *marks), f"{root}/{name}")
    written = spark.read.parquet(f"{root}/{name}")
    rejects = written.where(F.size("_bad") > 0).select(
        F.col("_file").alias("file"), F.col("_row").alias("row"), F.inline("_bad")
    )
    if max_rejects is not None:
        found = rejects.groupBy("column").agg(F.count("*").alias("n")).orderBy("column").collect()
        if sum(r["n"] for r in found) > max_rejects:
            raise ValueError(f"{path} has cells that do not fit: " + ", ".join(f"{r['column']} {r['n']}" for r in found))
    return written.select(*schema.names), rejects


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Read one table. CSV needs a schema and a header.

    CSV columns are found by name, whatever their order; columns beyond the schema are
    left out and a missing one is a ValueError. A cell that is neither missing nor of
    its column's type stops the job that reads it.
    """
    if fmt == "csv":
        text = _csv_text(spark, path, schema)
        return text.select(*[_typed(f).alias(f.name) for f in schema])
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", order=()) -> None:
    """Write one table; ``order`` sorts within each output file."""
    if order:
        df = df.sortWithinPartitions(*order)
    if fmt == "csv":
        flags = {
            f.name: F.when(F.col(f.name), "TRUE").when(~F.col(f.name), "FALSE")
            for f in df.schema
            if isinstance(f.dataType, T.BooleanType)
        }
        df.withColumns(flags).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def stage(
    df: DataFrame, root: str, name: str, order=("id", "visdate"), buckets: int | None = None
) -> DataFrame:
    """Write a stage table under ``root`` and continue from the written copy.

    Later stages read only the columns they need, and a lost executor repeats no
    earlier stage. With ``buckets`` the table is bucketed by its first ``order``
    column, so windows and joins of later stages on it need no shuffle; the table
    is then registered in the session's catalog under a name made from its path.
    """
    path, order = f"{root}/{name}", [c for c in order if c in df.columns]
    if not buckets or not order:
        write_table(df, path, order=order)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    table = f"stage_{name}_{zlib.crc32(path.encode()):08x}"
    (
        df.repartition(buckets, order[0])
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, order[0])
        .sortBy(*order)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def settle(df: DataFrame, name: str, order=("id", "visdate")) -> DataFrame:
    """Write a table that several branches of one plan read, into the checkpoint folder.

    The copy is removed when the session ends.
    Where the catalog lives in the session the copy is bucketed by its first
    ``order`` column, so the branches meet again without a shuffle.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    local_catalog = spark.conf.get("spark.sql.catalogImplementation") == "in-memory"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if local_catalog else None
    return stage(df, folder, name, order, buckets)
