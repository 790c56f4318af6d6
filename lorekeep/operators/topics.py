"""The graph of topics: nodes with their domains, edges where domains share a topic, bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(records: DataFrame) -> DataFrame:
    """(topic, domains, count, dates): sorted distinct domains, and the last five dates; 'general' and blank names stay out."""
    named = records.where("topic IS NOT NULL AND topic <> '' AND topic <> 'general' AND domain IS NOT NULL AND domain <> ''")
    dates = F.sort_array(F.collect_set("filed_at"), asc=False)
    return named.groupBy("topic").agg(F.sort_array(F.collect_set("domain")).alias("domains"), F.count(F.lit(1)).alias("n"), F.sort_array(F.slice(dates, 1, 5)).alias("dates"))


def edges(topic_nodes: DataFrame) -> DataFrame:
    """(topic, domain_a, domain_b, n) for each pair of domains that share a topic; a topic has few domains."""
    a = topic_nodes.select("topic", "n", "domains", F.posexplode("domains").alias("p", "domain_a"))
    rest = a.select("topic", "n", "domain_a", F.explode(F.slice("domains", F.col("p") + 2, F.size("domains"))).alias("domain_b"))
    return rest.select("topic", "domain_a", "domain_b", "n")


def curated(found: DataFrame, deny: DataFrame, allow: DataFrame, boost: DataFrame, n: int = 50) -> DataFrame:
    """Edges without the denied, with the allowed ones, ranked by count plus boost; rule tables are hand-made lists."""
    key = ["topic", "domain_a", "domain_b"]
    kept = found.join(F.broadcast(deny), key, "left_anti")
    more = allow.join(kept.select(*key), key, "left_anti").select(*key, F.lit(0).cast("long").alias("n"))
    ranked = kept.unionByName(more).join(F.broadcast(boost), key, "left")
    return ranked.select(*key, (F.col("n") + F.coalesce("boost", F.lit(0))).alias("rank_value")).orderBy(F.desc("rank_value"), *key).limit(n)


def traverse(topic_nodes: DataFrame, start: str, hops: int = 2, n: int = 50) -> DataFrame:
    """Topics within ``hops`` of a topic over shared domains, nearest first; (topic, hop, n).

    Each hop goes topics -> domains -> topics, and only topics not seen before go on.
    """
    pairs = topic_nodes.select("topic", F.explode("domains").alias("domain"))
    seen = topic_nodes.where(F.col("topic") == start).select("topic", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        near = pairs.join(frontier.select("topic"), "topic", "left_semi").select("domain").distinct()
        reached = pairs.join(near, "domain", "left_semi").select("topic").distinct()
        frontier = reached.join(seen.select("topic"), "topic", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.join(topic_nodes.select("topic", "n"), "topic").orderBy("hop", F.desc("n"), "topic").limit(n)


def stats(topic_nodes: DataFrame) -> DataFrame:
    """One row: topics, those in several domains, and edges."""
    pairs = F.size("domains") * (F.size("domains") - 1) / 2
    return topic_nodes.agg(F.count(F.lit(1)).alias("topics"), F.count_if(F.size("domains") > 1).alias("bridges"), F.sum(pairs).cast("long").alias("edges"))
