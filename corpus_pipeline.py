"""A cleaning pipeline over ``documents``, of five stages that each call one of the corpus operators.

Each stage takes what its predecessor kept, is written as Parquet to the shared folder and read again. All but the last
return the columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontaminate, jaccard, packing, pseudonyms, quality, registry, runtime

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words of a shingle, and the percentage of shared shingles, of the stage that removes near duplicates.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links (shingles of SHINGLE words, a similarity of PERCENT or more), the one with the least
    doc_id stays, and of rows that repeat a doc_id with one text, one: the first in the order of their other columns. Rows
    that repeat a doc_id with different texts are one document, and stay or go together; rows without a doc_id all stay."""
    found = jaccard.jaccard_components(docs, size=SHINGLE, percent=PERCENT).where("doc_id <> component_id").select("doc_id").distinct()
    found = runtime.store(found, "pipeline-removed")
    kept = docs.join(_small(found), "doc_id", "left_anti").select(*docs.columns)
    again = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = runtime.store(again, "pipeline-repeated")
    if again.isEmpty():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min(F.struct(*(F.col(f"`{c}`") for c in others))).alias("first") if others else F.lit(None).alias("first")
    once = kept.join(_small(again), "doc_id", "left_semi").groupBy("doc_id", "text").agg(first)
    once = once.select(*(F.col(f"`{c}`") if c in ("doc_id", "text") else F.col("first")[c].alias(c) for c in docs.columns))
    return kept.join(_small(again), "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def _small(ids: DataFrame) -> DataFrame:
    """Stored ids, marked for a broadcast if there are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, runtime.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; ``n_chars``, where it is there, follows the text."""
    out = pseudonyms.pseudonymise(docs, registry.pseudonym_key())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *registry.bpe_50k())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", remove_leaks),
    ("pii_pseudonyms", hide_personal_data),
    ("packing", pack),
]

#: Packing needs a tokenizer, which SQL can't express: the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = runtime.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = runtime.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            runtime.drop(before)
        before = docs
    return docs
