"""Documents as a project's files, and conversations as transcripts, made into records. Where chunks end is no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.operators import ingest
from lorekeep.plans.registry import register
from lorekeep.plans.text_queries import TOPICS

ROOMS = {"web": ["page", "site"], "books": ["book", "chapter"], "code": ["function", "class"]}


@register("ingest_documents")
def ingest_documents(spark, root):
    files = table(spark, root, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return ingest.project_records(files, "corpus", ROOMS, "reader", None).select("id", "topic", "source_file", "chunk_index", "document")


@register("ingest_conversations")
def ingest_conversations(spark, root):
    turns = table(spark, root, "conversations")
    line = F.concat(F.when(F.col("role") == "user", F.lit("> ")).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"])
    transcripts = turns.groupBy("conv_id").agg(F.array_join(said, "\n").alias("text")).select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("path"), "text")
    return ingest.conversation_records(transcripts, "talks", TOPICS, "reader", None).select("id", "topic", "source_file", "chunk_index", "document")
