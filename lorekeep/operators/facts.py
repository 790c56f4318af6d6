"""Temporal facts: (subject, predicate, object) with an open or closed span of validity, as ISO strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def normal_predicate(predicate: Column) -> Column:
    return F.replace(F.lower(predicate), F.lit(" "), F.lit("_"))


def valid_at(day: str | Column) -> Column:
    """Both ends belong to the span; a missing end is open. ISO strings compare as text."""
    t = F.lit(day) if isinstance(day, str) else day
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t))


def outgoing(facts: DataFrame, name: str) -> DataFrame:
    return facts.where(entity_id(F.col("subject")) == entity_id(F.lit(name)))


def both_ways(facts: DataFrame, name: str) -> DataFrame:
    """Facts from and to an entity; one from it to itself appears in both directions."""
    to = facts.where(entity_id(F.col("object")) == entity_id(F.lit(name)))
    return outgoing(facts, name).withColumn("direction", F.lit("outgoing")).unionByName(to.withColumn("direction", F.lit("incoming")))


def relationship(facts: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    out = facts.where(F.col("predicate") == normal_predicate(F.lit(predicate)))
    return out if as_of is None else out.where(valid_at(as_of))


def timeline(facts: DataFrame, name: str | None = None, n: int = 100) -> DataFrame:
    """By start, missing starts last, ties by id."""
    if name is not None:
        key = entity_id(F.lit(name))
        facts = facts.where((entity_id(F.col("subject")) == key) | (entity_id(F.col("object")) == key))
    return facts.orderBy(F.asc_nulls_last("valid_from"), "fact_id").limit(n)


def stats(facts: DataFrame) -> DataFrame:
    """One row: distinct entities, facts, current and expired ones, predicates."""
    entities = facts.select("subject").unionByName(facts.select(F.col("object").alias("subject"))).select(entity_id(F.col("subject")).alias("e")).distinct()
    counted = entities.agg(F.count(F.lit(1)).alias("entities"))
    summed = facts.agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if(F.col("valid_to").isNull()).alias("current"),
        F.count_if(F.col("valid_to").isNotNull()).alias("expired"),
        F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"),
    )
    return summed.join(F.broadcast(counted))  # one row each


def invalidate(facts: DataFrame, match: Column, ended: str) -> DataFrame:
    """Closes the matching open facts."""
    return facts.withColumn("valid_to", F.when(match & F.col("valid_to").isNull(), F.lit(ended)).otherwise(F.col("valid_to")))


def add(facts: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` without those of which the same fact is open already; repeated ones count once."""
    key = ["subject", "predicate", "object"]
    normal = new.withColumn("predicate", normal_predicate(F.col("predicate"))).dropDuplicates(key)
    return normal.join(facts.where(F.col("valid_to").isNull()).select(*key), key, "left_anti")


def conflicts(proposed: DataFrame, facts: DataFrame) -> DataFrame:
    """Each proposal with the other objects that open facts have for its subject and predicate."""
    held = facts.where(F.col("valid_to").isNull()).select("subject", "predicate", F.col("object").alias("held")).distinct()
    joined = proposed.join(held, ["subject", "predicate"], "left")
    other = F.collect_set(F.when(F.col("held") != F.col("object"), F.col("held")))
    return joined.groupBy("fact_id", "subject", "predicate", "object").agg(F.array_join(F.sort_array(other), ",").alias("conflicting"))
