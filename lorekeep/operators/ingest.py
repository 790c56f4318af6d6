"""Projects and conversations as records: files that pass are given a room, cut into chunks, and put into a versioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.engine.shared import store
from lorekeep.functions.names import room_of
from lorekeep.functions.noise import strip, strip_noise
from lorekeep.functions.probes import file_rejection
from lorekeep.functions.skeleton import shortened
from lorekeep.operators.chunks import exchange_units, pieces
from lorekeep.operators.texts import keyword_topic
from lorekeep.sources import files
from lorekeep.sources.versions import VersionedTable

#: A text under so many characters is no record.
LEAST = 50


def record_id(domain: Column, topic: Column, source: Column, index: Column) -> Column:
    """The path and the number are parted by a NUL, which no path holds: file ``a1``, chunk 1 and file ``a``, chunk 11 differ."""
    digest = F.sha2(F.concat_ws("\u0000", source, index.cast("string")), 256)
    return F.concat(F.lit("drawer_"), domain, F.lit("_"), topic, F.lit("_"), F.substring(digest, 1, 24))


def _records(cut: DataFrame, domain: str, agent: str, mode: str) -> DataFrame:
    """Records of (source_file, topic, chunk_index, document, ...); further columns stay."""
    named = cut.withColumn("domain", F.lit(domain)).withColumn("added_by", F.lit(agent)).withColumn("ingest_mode", F.lit(mode))
    return named.withColumn("id", record_id(F.col("domain"), F.col("topic"), F.col("source_file"), F.col("chunk_index")))


def project_records(texts: DataFrame, domain: str, rooms: dict[str, list[str]], agent: str, head: int | None = 2000, skeletons: bool = True) -> DataFrame:
    """Records of the files (path, text, ...): those that no rule rejects, each in its room, cut at breaks.

    Null and short texts give none. Chunks are numbered from 0 in each file, and a file's chunks have the same ids each time. Of a
    large source only its skeleton is cut, if that is less than half as long: ``is_skeleton`` tells.
    """
    stripped = texts.withColumnRenamed("path", "source_file").withColumn("text", strip(F.col("text")))
    good = stripped.where((F.length("text") >= LEAST) & file_rejection(F.col("text"), F.col("source_file")).isNull())
    placed = good.withColumn("topic", room_of(F.col("source_file"), F.col("text"), rooms, head))
    short = shortened(F.col("source_file"), F.col("text")) if skeletons else F.lit(None).cast("string")
    placed = placed.withColumn("_short", short).withColumn("is_skeleton", F.col("_short").isNotNull()).withColumn("text", F.coalesce("_short", "text")).drop("_short")
    others = [c for c in placed.columns if c != "text"]
    return _records(placed.select(*others, F.posexplode(pieces("text")).alias("chunk_index", "document")), domain, agent, "registry")


def skeleton_sources(records: DataFrame) -> DataFrame:
    """(domain, source_file, chunks): the files of which only a skeleton is kept; those without a domain or a file are left out."""
    named = (F.coalesce("domain", F.lit("")) != "") & (F.coalesce("source_file", F.lit("")) != "")
    return records.where(F.coalesce("is_skeleton", F.lit(False)) & named).groupBy("domain", "source_file").agg(F.count(F.lit(1)).alias("chunks"))


def conversation_records(transcripts: DataFrame, domain: str, topics: dict[str, list[str]], agent: str, head: int | None = 3000) -> DataFrame:
    """Records of the transcripts (path, text, ...): noise goes, each has one topic, and is cut into its exchanges."""
    clean = transcripts.withColumnRenamed("path", "source_file").withColumn("text", strip(strip_noise(F.col("text"))))
    placed = clean.where(F.length("text") >= LEAST).withColumn("topic", keyword_topic(F.col("text"), topics, head))
    others = [c for c in placed.columns if c != "text"]
    return _records(placed.select(*others, F.posexplode(exchange_units(F.col("text"))).alias("chunk_index", "document")), domain, agent, "convos")


def ingest_project(spark: SparkSession, root: str, table: VersionedTable, domain: str, rooms: dict[str, list[str]], agent: str, **scan) -> int | None:
    """Reads the files under ``root`` that ``table`` doesn't hold as they are now, and replaces their records in this domain;
    returns the new version, or None where nothing is new. A file that is rejected now keeps the records it had."""
    listing = files.scan(spark, root, **scan)
    known = table.versions()
    if known:
        listing = files.unread(listing, table.read().where(F.col("domain") == domain).select("source_file", "modified").distinct())
    texts = listing.select("path", "modified", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    batch = store(project_records(texts, domain, rooms, agent), "ingest-batch")
    if not known:
        return table.write(batch, 0, "ingest")
    return None if batch.isEmpty() else table.replace_sources(batch)


def restore_sources(spark: SparkSession, root: str, table: VersionedTable, domain: str, rooms: dict[str, list[str]], agent: str, **scan) -> int | None:
    """Puts whole files in place of their skeletons in this domain; returns the new version, or None where there is none. Files that
    aren't there any more keep their skeletons."""
    wanted = store(skeleton_sources(table.read().where(F.col("domain") == domain)).select(F.col("source_file").alias("path")), "skeletons")
    listing = files.scan(spark, root, **scan).join(wanted, "path", "left_semi")
    texts = listing.select("path", "modified", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    batch = store(project_records(texts, domain, rooms, agent, skeletons=False), "restored")
    return None if batch.isEmpty() else table.replace_sources(batch)
