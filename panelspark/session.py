"""Session settings and the checkpoint folder."""

from __future__ import annotations

import hashlib
import io
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans are written for. None changes a result.
SETTINGS = {
    # Runtime re-planning: coalesced partitions, split of skewed join partitions,
    # broadcast only after the real size of a side is known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tables already partitioned by person join on (person, date) without a new
    # shuffle. Safe here: a person has at most one row per calendar day.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a running session and return it."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking it from ``spark.checkpoint.dir``.

    A private folder is made only for a local master with nothing configured; on
    a cluster a missing setting is an error, since a folder of one machine would
    be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="panelspark-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _share(spark: SparkSession, content: bytes, name: str, ending: str) -> str:
    """Write a file to the checkpoint folder, under a name that goes with its content."""
    target = f"{ensure_checkpoint_dir(spark)}/{name}-{hashlib.sha256(content).hexdigest()[:16]}.{ending}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(content))
    stream.close()
    return target


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per session, from the shared checkpoint folder.

    Tasks import it; nothing has to be installed on the machines they run on.
    """
    context = spark.sparkContext
    if getattr(context, "_panelspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    context.addPyFile(_share(spark, packed.getvalue(), "panelspark", "zip"))
    context._panelspark_shipped = True


def java_object(spark: SparkSession, source: Path, settings: dict):
    """An object of the Java class in ``source``, made from ``settings``, which executors can use as well.

    Spark's own compiler (Janino, which compiles its plans) makes the class once per
    session; executors get it as a jar from the shared checkpoint folder.
    """
    context, jvm = spark.sparkContext, spark._jvm
    made = context.__dict__.setdefault("_panelspark_java", {})
    if source not in made:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source.read_text())
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as out:
            for name, code in sorted(dict(compiler.getBytecodes()).items()):
                out.writestr(zipfile.ZipInfo(f"{name.replace('.', '/')}.class"), bytes(code))
        context._jsc.sc().addJar(_share(spark, packed.getvalue(), source.stem, "jar"))
        made[source] = compiler.getClassLoader().loadClass(f"panelspark.{source.stem}")
    given = context._gateway.new_array(jvm.java.lang.Object, 1)
    given[0] = jvm.java.util.HashMap(settings)
    return made[source].getConstructors()[0].newInstance(given)


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from a checkpoint, its plan cut there.

    Rows are kept while the checkpoint is written; without that Spark would
    compute the last stage twice, once for the count and once for the files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist()
    done = df.checkpoint()
    df.unpersist()
    return done


def drop_cut(df: DataFrame) -> None:
    """Remove the files of ``cut(...)``'s result, once nothing reads them any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def remove_path(jvm, jsc, path: str) -> None:
    """Delete a file or folder wherever it is stored; nothing happens once the JVM is gone."""
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the gateway may be gone at exit
        pass


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the session's Python side ends."""
    weakref.finalize(spark, remove_path, spark._jvm, spark._jsc, path)
