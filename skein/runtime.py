"""Session-level helpers: partition counts and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. In local mode, where it may be unset, a temporary one; a cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def discard(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that materialize() gave, once nothing reads it any more."""
    path = getattr(df, "_skein_path", None)
    if path:
        fs, p = _path(df.sparkSession, path)
        fs.delete(p, True)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back: the lineage is cut and no executor holds the only copy.

    The table goes when the driver's JVM ends, or by discard().
    """
    path = scratch(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: a table of one small file is else the work of one core.

    A table of more files than cores, as any large one is, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="skein-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/skein-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)
