"""Tables written to the folder that the driver and all executors share, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (some tens of bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Leading bits of a key that name a row of a map of keys, of which each has 64.
SLOT_BITS = 18
#: Spark's setting that deletes a query's shuffle files once the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lorekeep-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the driver ends; a driver that dies leaves it there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def drop(*stored: DataFrame) -> None:
    """Deletes the files of stored tables."""
    for df in stored:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored narrow table, marked for a broadcast if it has few enough rows."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def sieve(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key``, a hash of 64 bits, is none of ``wanted`` (key): what is left still has to be joined.

    Only a map of the wanted keys is broadcast, a bit for each and 2 ** SLOT_BITS rows at most, however many there are."""
    slot = lambda k: F.shiftrightunsigned(k, 64 - SLOT_BITS)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k.bitwiseAND(63).cast("int"))
    bits = store(wanted.groupBy(slot(F.col("key")).alias("_slot")).agg(F.bit_or(bit(F.col("key"))).alias("_bits")), "sieve")
    met = rows.withColumn("_slot", slot(key)).join(F.broadcast(bits), "_slot").where(F.col("_bits").bitwiseAND(bit(key)) != 0)
    return met.drop("_slot", "_bits")
