"""Catalog summaries: counts by domain and topic, activity, briefs, recent and stale entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """Absent names count as 'unknown'."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))


def count_by(records: DataFrame, *columns: str) -> DataFrame:
    return records.groupBy(*(named(c).alias(c) for c in columns)).agg(F.count(F.lit(1)).alias("n"))


def taxonomy(records: DataFrame) -> DataFrame:
    """Domain, topic and pair counts in one pass; ``level``: 1 pair, 2 domain, 3 topic."""
    base = records.select(named("domain").alias("domain"), named("topic").alias("topic"))
    sets = base.groupingSets([["domain", "topic"], ["domain"], ["topic"]], "domain", "topic")
    level = F.when(F.grouping("topic") == 1, 2).when(F.grouping("domain") == 1, 3).otherwise(1)
    return sets.agg(F.count(F.lit(1)).alias("n"), level.alias("level"))


def activity(records: DataFrame) -> DataFrame:
    """The latest date of each domain, as an ISO string."""
    return records.groupBy(named("domain").alias("domain")).agg(F.max(F.nullif("filed_at", F.lit(""))).alias("latest"))


def brief(records: DataFrame) -> DataFrame:
    """Totals of each domain: records, topics, contributors, source files."""
    return records.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("topic").alias("topics"),
        F.countDistinct("contributor").alias("contributors"),
        F.countDistinct("source_file").alias("source_files"),
    )


def gist(document: Column, size: int = 80) -> Column:
    """The first line of a text, cut."""
    return F.substring(F.get(F.split(F.trim(document), "\n", 2), 0), 1, size)


def recent(records: DataFrame, n: int = 5) -> DataFrame:
    return records.orderBy(F.desc("filed_at"), F.desc("id")).limit(n).select("id", "filed_at", "topic", gist(F.col("document")).alias("gist"))


def stale(records: DataFrame, now: str, months: int = 3, n: int = 10) -> DataFrame:
    """Domains whose latest record is older than so many months of 30 days; the oldest first."""
    limit = F.date_sub(F.lit(now).cast("date"), 30 * months).cast("string")
    return activity(records).where(F.col("latest") < limit).orderBy("latest", "domain").limit(n)


def top(records: DataFrame, n: int = 15) -> DataFrame:
    return count_by(records, "domain").orderBy(F.desc("n"), "domain").limit(n)


def reads(records: DataFrame, where: Column, offset: int, limit: int) -> DataFrame:
    """A page of the records under a predicate, in the order of their ids."""
    return records.where(where).orderBy("id").offset(offset).limit(limit)


def estimated_duplicates(records: DataFrame, least: int = 20) -> DataFrame:
    """Per source with more than ``least`` records: two in five are taken for duplicates."""
    return records.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).withColumn("estimated", F.floor(F.col("n") * 2 / 5).cast("long"))


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]{2,})"), 1), F.lower)


#: Capitalised words that cards take for names of things.
ENTITY = r"(?U)\b([A-Z][A-Za-z0-9_-]{2,})\b"


def cards(records: DataFrame, words: int = 4, by: tuple[str, ...] = ("domain", "topic")) -> DataFrame:
    """For each group: its most frequent tokens by (count, token), joined."""
    return _most(records, tokens(F.col("document")), words, by, F.col("token"), "top_tokens", " ")


def card_entities(records: DataFrame, names: int = 5, by: tuple[str, ...] = ("domain", "topic")) -> DataFrame:
    """For each group: its most frequent capitalised words by (count, word in lower case, word), joined."""
    return _most(records, F.regexp_extract_all("document", F.lit(ENTITY), 1), names, by, F.lower("token"), "top_entities", ",")


def _most(records: DataFrame, words: Column, most: int, by: tuple[str, ...], tie: Column, name: str, mark: str) -> DataFrame:
    counted = records.select(*by, F.explode(words).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    first = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), tie, "token"))).where(F.col("rank") <= most)
    return first.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), mark).alias(name))
