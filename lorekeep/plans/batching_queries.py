"""Records in the batches of a writer's buffer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.operators.batching import batched
from lorekeep.plans.registry import register

SIZE, MOST = 16, 30_000
# The buffer itself, one record a step: a batch that reached a limit is left behind before the next record comes.
_LOOP = f"""{V.RECORDS_SQL}, ordered AS (
  SELECT id, length(document) AS chars, row_number() OVER (ORDER BY domain, id) AS k FROM records
), loop AS (
  SELECT id, k, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS rows, CAST(chars AS BIGINT) AS held FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.id, o.k, CASE WHEN rows >= {SIZE} OR held >= {MOST} THEN batch + 1 ELSE batch END,
         CASE WHEN rows >= {SIZE} OR held >= {MOST} THEN 1 ELSE rows + 1 END, CASE WHEN rows >= {SIZE} OR held >= {MOST} THEN o.chars ELSE held + o.chars END
  FROM loop JOIN ordered o ON o.k = loop.k + 1
)"""


def _batched(spark, root):
    rows = V.records(spark, root).select("domain", "id", F.length("document").alias("chars"))
    return batched(rows, "domain", "id", size=SIZE, most=MOST)


@register("write_batches", f"WITH RECURSIVE {_LOOP} SELECT id, batch FROM loop")
def write_batches(spark, root):
    return _batched(spark, root).select("id", "batch")


@register("write_batch_sizes", f"WITH RECURSIVE {_LOOP} SELECT batch, max(rows) AS records, CAST(max(held) AS BIGINT) AS chars FROM loop GROUP BY batch")
def write_batch_sizes(spark, root):
    return _batched(spark, root).groupBy("batch").agg(F.count(F.lit(1)).alias("records"), F.sum("chars").cast("long").alias("chars"))
