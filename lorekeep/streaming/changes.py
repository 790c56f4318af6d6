"""Structured Streaming forms of the stateful operators: change capture, sequence numbers, save triggers, logs.

Sequence numbers and save triggers keep one small counter for each key; the merge keeps nothing in state, its table is the
state. Sinks get each batch at least once: those here give the same result when a batch comes again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.engine.shared import store
from lorekeep.operators import sync
from lorekeep.sources.versions import VersionedTable


def stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they arrive under ``path``, at most ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def version_vectors(changes: DataFrame) -> DataFrame:
    """The greatest sequence number of each node so far; run in update mode."""
    return sync.version_vector(changes)


def counted(changes: DataFrame, key: str, order: str) -> DataFrame:
    """``changes`` with ``nth``: 1, 2, ... for each ``key``, continued from batch to batch; by ``order`` inside one.

    A key's rows of a batch come in Arrow batches, in the order of arrival; each is numbered in its own order.
    """
    schema = changes.schema
    out = schema.fieldNames()

    def number(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values(order, kind="stable")[out]
            rows["nth"] = range(done + 1, done + len(rows) + 1)
            done += len(rows)
            yield rows
        state.update((done,))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return changes.groupBy(key).applyInPandasWithState(number, f"{kinds}, nth long", "done long", "append", GroupStateTimeout.NoTimeout)


def save_triggers(turns: DataFrame, every: int = 15) -> DataFrame:
    """Users' turns that complete a multiple of ``every`` in their session."""
    return counted(turns.where("role = 'user'"), "conv_id", "turn").where(F.col("nth") % every == 0)


def windowed_counts(events: DataFrame, time: str, *keys: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events in windows of ``width`` by ``keys``; those that come later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def merge_into(changes: DataFrame, table: VersionedTable, checkpoint: str) -> DataStreamWriter:
    """A writer that merges each batch into ``table`` by id: the later change wins, at the same time the greater node.

    A batch that comes again changes nothing, as none of its rows is later than what the table holds.
    """

    def merge(batch: DataFrame, _: int) -> None:
        best = sync.latest(batch)
        if not table.versions():
            table.write(best, 0, "merge")
            return
        best = store(best, "merge-batch")
        table.change(lambda base: sync.merge(base, best).drop("outcome"), best, "merge")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def append_log(entries: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of JSON lines under ``path``; Spark's file sink writes each batch once."""
    return entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_log(spark: SparkSession, path: str, schema: str = "operation string, at string, params string, result string") -> DataFrame:
    """Entries of such a log; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def deduplicated(changes: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Each (node_id, seq) once, as long as its repetitions come within ``late``."""
    return changes.withWatermark(time, late).dropDuplicatesWithinWatermark(["node_id", "seq"])


def allocate(rows: DataFrame, vector: DataFrame, order: str) -> DataFrame:
    """Batch form of the counter: rows numbered on from what ``vector`` (node_id, seq) holds for their node."""
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy(order))
    known = vector.select("node_id", F.col("seq").alias("_last"))
    return rows.join(known, "node_id", "left").withColumn("seq", (nth + F.coalesce("_last", F.lit(0))).cast("long")).drop("_last")
