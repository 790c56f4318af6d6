"""The engine's tables (records, vectors, facts, changes, sessions, calls) as views of the driver's tables.

Each view stands next to the SQL of the same view, with which the DuckDB oracles begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.engine.session import table

RECORDS_SQL = """records AS (
  SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, text AS document, lang AS domain, source AS topic,
         source || '.txt' AS source_file, doc_id AS chunk_index,
         strftime(DATE '2024-01-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d') AS filed_at,
         lang || '_' || (doc_id % 3) AS contributor
  FROM documents)"""


def records(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(
        F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"),
        F.col("text").alias("document"),
        F.col("lang").alias("domain"),
        F.col("source").alias("topic"),
        F.concat("source", F.lit(".txt")).alias("source_file"),
        F.col("doc_id").alias("chunk_index"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")).cast("string").alias("filed_at"),
        F.concat_ws("_", "lang", (F.col("doc_id") % 3).cast("string")).alias("contributor"),
    )


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


FACTS_SQL = """facts AS (
  SELECT o_orderkey AS fact_id, c_name AS subject, 'ordered_' || lower(substr(o_orderpriority, 1, 1)) AS predicate,
         CAST(o_orderstatus AS VARCHAR) AS object, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS valid_from,
         CASE WHEN o_orderstatus = 'F' THEN strftime(CAST(o_orderdate AS DATE) + 90, '%Y-%m-%d') END AS valid_to
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def facts(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    names = table(spark, root, "customer").select("c_custkey", "c_name")
    return orders.join(names, orders["o_custkey"] == names["c_custkey"]).select(
        F.col("o_orderkey").alias("fact_id"),
        F.col("c_name").alias("subject"),
        F.concat(F.lit("ordered_"), F.lower(F.substring("o_orderpriority", 1, 1))).alias("predicate"),
        F.col("o_orderstatus").alias("object"),
        F.col("day").cast("string").alias("valid_from"),
        F.when(F.col("o_orderstatus") == "F", F.date_add("day", 90).cast("string")).alias("valid_to"),
    )


CHANGES_SQL = """changes AS (
  SELECT event_id, event_type AS node_id, user_id % 400 AS record_id, epoch_us(ts) // 1000000 AS updated_at, value
  FROM events)"""


def changes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.col("event_type").alias("node_id"), (F.col("user_id") % 400).alias("record_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("updated_at"), "value")


CALLS_SQL = """calls AS (
  SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'status'
         WHEN 'purchase' THEN 'add_record' WHEN 'signup' THEN 'checkpoint' ELSE 'fact_add' END AS tool
  FROM events)"""

TOOLS = {"view": "search", "click": "status", "purchase": "add_record", "signup": "checkpoint"}


def calls(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("event_type")
    tool = F.coalesce(*(F.when(kind == k, v) for k, v in TOOLS.items()), F.lit("fact_add"))
    return table(spark, root, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), tool.alias("tool"))
