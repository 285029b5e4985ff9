"""Session-level helpers shared by every operator: loading tables, spreading
small inputs over the cluster, cutting lineage in the shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each application: what a
    worker unpickles may name a module that only the driver's path holds.

    The archive lies in the shared folder.  Without one (a cluster that names
    none) the workers have to find the package themselves.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    try:
        path = f"{shared_dir(spark)}/vellumgrid/package-{sc.applicationId}.zip"  # outlives clear()
    except ValueError:
        return
    root, archive = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(archive.getvalue()))
    out.close()
    sc.addPyFile(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the test data; columns are pruned by whatever selects from it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan has fewer splits than the cluster has cores.

    A large table has thousands of splits and passes through untouched; a table
    of one file would otherwise leave all cores but one idle in a Python stage.
    """
    n = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's spark.checkpoint.dir.

    Only where that is unset and the master is a single local JVM (tests) is a
    temporary folder made; on a cluster an unset folder is an error.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"vellumgrid-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_OWN: set[str] = set()


def workspace(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends, or by clear()."""
    path = f"{shared_dir(spark)}/vellumgrid/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)  # only what is there can be marked
        fs.deleteOnExit(at)
    return path


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no DataFrame that reads them is needed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(workspace(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, a lost
    executor costs nothing, later readers still prune columns and push filters."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
