"""What the operators share: tables, the shared folder, and the code that executors need."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
#: Spark's setting that deletes a query's shuffle files once the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lorekeep-"))
    return sc.getCheckpointDir()


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: a lost executor loses none of it. The files go when the
    driver ends, if nothing deletes them before; the shuffle files of the write go once it is done, as nothing reads them
    again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a stored table."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they are local and find it by PYTHONPATH."""
    sc = spark.sparkContext
    on_path = str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if (sc.master.split("[")[0] == "local" and on_path) or getattr(sc, "_lorekeep_shipped", False):
        return
    # Executors fetch the archive whenever they start, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="lorekeep-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "lorekeep_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._lorekeep_shipped = True
