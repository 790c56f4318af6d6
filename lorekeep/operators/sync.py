"""Change capture between replicas: version vectors, unseen changes, last-writer-wins merge, tombstones.

Tables of a replica have (id, node_id, seq, updated_at, ...). Nothing is updated in place: each operator returns the next
version of a table, to be written beside the old one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stamp(rows: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Numbers each node's rows from ``start`` + 1 on."""
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("node_id").orderBy(order)) + start).cast("long"))


def version_vector(rows: DataFrame) -> DataFrame:
    return rows.where("node_id <> '' AND seq > 0").groupBy("node_id").agg(F.max("seq").alias("seq"))


def unseen(rows: DataFrame, vector: DataFrame) -> DataFrame:
    """Rows past what the vector knows of their node; a vector has one row for each node."""
    known = F.broadcast(vector.select("node_id", F.col("seq").alias("known")))
    return rows.join(known, "node_id", "left").where(F.col("seq") > F.coalesce("known", F.lit(0))).drop("known")


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return rows.orderBy("id").offset(offset).limit(limit)


def merged_vector(*vectors: DataFrame) -> DataFrame:
    """What is known where any of the vectors knows it; no node's number falls."""
    return version_vector(reduce(DataFrame.unionByName, (v.select("node_id", "seq") for v in vectors)))


def tombstones(targets: DataFrame, by: str, reason: str, now: str, grace_days: int = 90) -> DataFrame:
    """A tombstone for each distinct (id); its grace lasts so many days from the day ``now``."""
    until = F.date_add(F.lit(now).cast("date"), grace_days).cast("string")
    marked = targets.select(F.concat(F.lit("tombstone:"), "id").alias("id"), F.col("id").alias("target")).distinct()
    return marked.select("id", "target", F.lit(by).alias("deleted_by"), F.lit(reason).alias("reason"), until.alias("grace_until"), F.lit(now).alias("created_at"))


def latest(rows: DataFrame) -> DataFrame:
    """One row for each id: the latest, ties by node and sequence."""
    best = F.max_by(F.struct(*rows.columns), F.struct("updated_at", "node_id", "seq"))
    return rows.groupBy("id").agg(best.alias("r")).select("r.*")


def remote_wins() -> Column:
    """Later time wins; at the same time the greater node; a tie of both keeps the local row."""
    return F.struct(F.col("r.updated_at"), F.col("r.node_id")) > F.struct(F.col("l.updated_at"), F.col("l.node_id"))


def merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, outcome, ...): 'new', 'updated', 'kept' for remote rows that are newer or not, 'local' for others; the
    other columns are the winner's."""
    joined = local.alias("l").join(remote.alias("r"), F.col("l.id") == F.col("r.id"), "full_outer")
    outcome = F.when(F.col("l.id").isNull(), "new").when(F.col("r.id").isNull(), "local").when(remote_wins(), "updated").otherwise("kept")
    columns = [c for c in local.columns if c != "id"]
    pick = lambda c: F.when(F.col("outcome").isin("new", "updated"), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c)
    return joined.withColumn("outcome", outcome).select(F.coalesce("l.id", "r.id").alias("id"), "outcome", *(pick(c) for c in columns))


def upsert(base: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """``batch`` over ``base`` by id; of several rows with one id in the batch the last by ``order`` counts."""
    last = batch.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("nth = 1").drop("nth")
    return base.join(last.select("id"), "id", "left_anti").unionByName(last)


def visible(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    return records.join(tombstones.select(F.col("target").alias("id")), "id", "left_anti")


def active_tombstones(tombstones: DataFrame, now: str) -> DataFrame:
    """Those whose grace isn't over; a missing or malformed date counts as not over."""
    until = F.try_to_timestamp("grace_until")
    return tombstones.where(until.isNull() | (until > F.lit(now).cast("timestamp")))


def pending(tombstones: DataFrame, now: str) -> DataFrame:
    """Targets whose grace is over."""
    return tombstones.where(F.try_to_timestamp("grace_until") <= F.lit(now).cast("timestamp"))


def collect_garbage(records: DataFrame, tombstones: DataFrame, requested: DataFrame, now: str) -> DataFrame:
    """Records without those that are requested and pending."""
    gone = pending(tombstones, now).select(F.col("target").alias("id")).join(requested.select("id"), "id", "left_semi")
    return records.join(gone, "id", "left_anti")


def content_id(domain: Column, topic: Column, content: Column) -> Column:
    digest = F.sha2(F.concat_ws("\u0000", domain, topic, content), 256)
    return F.concat(F.lit("record_"), domain, F.lit("_"), topic, F.lit("_"), F.substring(digest, 1, 24))
