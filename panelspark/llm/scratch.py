"""Written intermediate tables, and small Spark helpers shared by the operators."""

from __future__ import annotations

import hashlib
import io
import uuid
import weakref
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import ensure_checkpoint_dir

# Shuffle files of a finished job are removed with it, not when the driver happens
# to collect garbage; the written table replaces them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, **values: str):
    """Session options (dots written as ``__``) for the time of a block."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per session, from the shared checkpoint folder.

    Tasks import it; nothing has to be installed on the machines they run on.
    """
    context = spark.sparkContext
    if getattr(context, "_panelspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    code = packed.getvalue()
    target = f"{ensure_checkpoint_dir(spark)}/panelspark-{hashlib.sha256(code).hexdigest()[:16]}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(code))
    stream.close()
    context.addPyFile(target)
    context._panelspark_shipped = True


class Scratch:
    """Tables written below the shared checkpoint folder, cutting lineage.

    They outlive the executor that wrote them. ``drop`` removes one as soon as the
    next step is written; what the returned result still reads goes when the
    session's Python side ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._end = weakref.finalize(spark, _remove, spark._jvm, spark._jsc, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with setting(self.spark, **{_CLEAN: "true"}):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark._jvm, self.spark._jsc, f"{self.root}/{name}")


def _remove(jvm, jsc, path: str) -> None:
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the gateway may be gone at exit
        pass


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of text in the table, from one pass over that column."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def parts_for(size: int, per_part: int) -> int:
    """How many parts of some ``per_part`` bytes hold ``size`` bytes."""
    return max(1, -(-int(size) // per_part))


def crc_mod(key: Column | str, mod: int) -> Column:
    """crc32 of the key's decimal text, modulo ``mod``; a null key counts as ''."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
