"""Conversations written as text exports, and read by the data source of exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.engine.shared import new_folder
from lorekeep.plans.registry import register
from lorekeep.sources import readers

FILES = 20


@register(
    "exports_by_source",
    rf"""WITH line AS (
      SELECT conv_id % {FILES} AS f, conv_id, turn, CASE WHEN role = 'user' THEN '> ' ELSE '' END || regexp_replace(text, '[\r\n]+', ' ', 'g') || chr(10) AS line FROM conversations WHERE text IS NOT NULL
    )
    SELECT f AS file, sum(strlen(line))::BIGINT AS size, sha256(string_agg(line, '' ORDER BY conv_id, turn)) AS content_sha256 FROM line GROUP BY f""",
)
def exports_by_source(spark, root):
    turns = table(spark, root, "conversations").where("text IS NOT NULL").withColumn("f", F.col("conv_id") % FILES)
    line = F.concat(F.when(F.col("role") == "user", "> ").otherwise(""), F.regexp_replace("text", r"[\r\n]+", " "))
    path = new_folder(spark, "exports")
    turns.withColumn("value", line).repartition("f").sortWithinPartitions("f", "conv_id", "turn").select("f", "value").write.partitionBy("f").text(path)
    found = readers.exports(spark, path, F.col("path").contains("/f=") & (F.col("size") > 0), partitionBytes=1 << 20)
    return found.select(F.regexp_extract("path", r"/f=(-?\d+)/", 1).cast("long").alias("file"), "size", F.sha2("content", 256).alias("content_sha256"))
