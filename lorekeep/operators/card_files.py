"""Catalog cards kept as JSON files by domain: one card for each topic and source file of a domain.

A rebuild writes all. A refresh names the cards that a change touches, makes those anew from the records as they are now, takes the other
cards of their domains from the files, and writes the files of these domains only; domains without cards lose theirs. It states what the
cards are, not by how much they change, so it may be run again after a break. Ids of a card's records are no array in it, as one source may
hold a third of all records: ``members`` gives them as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.engine.shared import drop, store

# Words that no card is named after, and what words and names look like.
STOP = (
    "about after again auth because been between build clerk could does from have into just local migration notes over project room should source "
    "that their there these they this through under what when where which with would"
).split()
WORD = "([A-Za-z0-9_]{3,})"
NAME = r"(?U)\b([A-Z][A-Za-z0-9_-]{2,})\b"

KEY = ("domain", "room", "source_file")
SCHEMA = "room string, topic string, entities array<string>, source_file string, records bigint, domain string"


def members(records: DataFrame) -> DataFrame:
    """(domain, room, source_file, id, document) of records (id, document, domain, topic, source_file): which card each belongs to. A record
    without a domain is on none; one without a topic is under ``general``; a null file is an empty one."""
    known = records.where(F.coalesce("domain", F.lit("")) != "")
    room = F.coalesce(F.nullif("topic", F.lit("")), F.lit("general"))
    return known.select("domain", room.alias("room"), F.coalesce("source_file", F.lit("")).alias("source_file"), "id", F.coalesce("document", F.lit("")).alias("document"))


def _most(held: DataFrame, words: Column, most: int, tie: Column, name: str) -> DataFrame:
    """Each card's most frequent words. They are counted before they are ranked, and ranked within partitions first."""
    counted = held.select(*KEY, F.explode(words).alias("word")).groupBy(*KEY, "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("n"), tie, "word")
    first = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return first.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias(name))


def cards(records: DataFrame, words: int = 4, names: int = 5) -> DataFrame:
    """The cards of all records: topic (most frequent words, else the room), entities (most frequent capitalised words), number of records."""
    held = members(records)
    used = F.filter(F.transform(F.regexp_extract_all("document", F.lit(WORD), 1), F.lower), lambda w: ~w.isin(STOP))
    topics = _most(held, used, words, F.col("word"), "words")
    entities = _most(held, F.regexp_extract_all("document", F.lit(NAME), 1), names, F.lower("word"), "entities")
    counted = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("records"))
    joined = counted.join(topics, list(KEY), "left").join(entities, list(KEY), "left")
    topic = F.coalesce(F.array_join("words", " "), F.col("room"))
    return joined.select("room", topic.alias("topic"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "source_file", "records", "domain")


def _write(found: DataFrame, path: str, mode: str) -> None:
    ordered = found.repartitionByRange("domain", "room", "topic", "source_file").sortWithinPartitions("domain", "room", "topic", "source_file")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("domain").json(path)


def rebuild(records: DataFrame, path: str) -> None:
    """Writes the cards of all records; files of domains that have none go."""
    _write(cards(records), path, "static")


def load(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """The cards of a domain, or of all; only its files are read. No cards where none were written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    found = spark.read.schema(SCHEMA).json(path)
    return found if domain is None else found.where(F.col("domain") == domain)


def refresh(records: DataFrame, changed: DataFrame, path: str) -> list[str]:
    """Brings the cards up to ``records``, which are the records after the change; ``changed`` has domain, topic and source_file of all that it
    added, removed or altered, as they were and as they are. Returns the domains that have no cards any more."""
    spark = records.sparkSession
    whole = changed.select("domain", "topic", "source_file", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("document"))
    touched = store(members(whole).select(*KEY).distinct(), "touched-cards")
    domains = touched.select("domain").distinct()
    keyed = records.withColumn("_room", F.coalesce(F.nullif("topic", F.lit("")), F.lit("general"))).withColumn("_file", F.coalesce("source_file", F.lit("")))
    renamed = touched.select("domain", F.col("room").alias("_room"), F.col("source_file").alias("_file"))
    made = cards(keyed.join(renamed, ["domain", "_room", "_file"], "left_semi"))
    now = load(spark, path)
    kept = now.join(domains, "domain", "left_semi").join(touched, list(KEY), "left_anti")
    after = store(kept.unionByName(made), "cards")
    gone = domains.join(after.select("domain"), "domain", "left_anti")
    if now.inputFiles():
        located = spark.read.schema(SCHEMA).json(path).select("domain", F.col("_metadata.file_path").alias("file"))
        stale = located.join(gone, "domain", "left_semi").select("domain", F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()  # a row for each domain that ends
    else:
        stale = []
    _write(after, path, "dynamic")
    for _, folder in stale:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    drop(touched, after)
    return sorted(domain for domain, _ in stale)
