"""Search in two passes by hall: every twentieth conversation's first question against all conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.functions import halls as H
from lorekeep.operators import hall_search as S
from lorekeep.operators import retrieval as R
from lorekeep.plans.registry import register

# The tables' texts hold none of the halls' signals, so a conversation's number gives its hall; `session_halls` reads the texts.
HALLS = (H.PREFERENCES, H.ADVICE, H.EVENTS, H.FACTS, H.GENERAL)
_HALL = "['hall_preferences', 'hall_assistant_advice', 'hall_events', 'hall_facts', 'hall_general']"
_TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x)))"
_STOPPED = "(" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + ")"
_SEARCH = f"""WITH q AS (
  SELECT conv_id AS query_id, {_TOKENS.format("arg_min(text, turn)")} AS w, conv_id // 20 % 5 AS h FROM conversations WHERE role = 'user' AND conv_id % 20 = 0 AND text IS NOT NULL GROUP BY conv_id
), words AS (
  SELECT query_id, h, token, count(*) OVER (PARTITION BY query_id) AS total FROM (SELECT query_id, h, unnest(w) AS token FROM q) WHERE token NOT IN {_STOPPED}
), held AS (
  SELECT DISTINCT conv_id AS id, -1 AS turn, unnest({_TOKENS.format("text")}) AS token FROM conversations WHERE role = 'user'
), wide AS (
  SELECT query_id, h, id, round(count(*) / any_value(total), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(count(*) / any_value(total), 6) DESC, id) AS k
  FROM words JOIN held USING (token) GROUP BY query_id, h, id
), units AS (
  SELECT * FROM held UNION ALL
  SELECT DISTINCT conv_id, turn, unnest({_TOKENS.format("text")}) FROM conversations WHERE role = 'assistant' AND length(text) > 30 AND conv_id % 5 = 1
), narrow AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(count(*) / any_value(total), 6) DESC, id, turn) AS k
  FROM words JOIN units USING (token) WHERE id % 5 = h AND h <> 4 GROUP BY query_id, id, turn
), hits AS (SELECT DISTINCT query_id, id FROM narrow WHERE k <= 10), scored AS (
  SELECT query_id, id, {_HALL}[id % 5 + 1] AS hall, hits.id IS NOT NULL AS confirmed,
    round((1 - score) * (1 - CAST(0.3 AS DOUBLE) * score) * CAST(CASE WHEN id % 5 = h AND h <> 4 THEN 0.75 WHEN id % 5 IN (h, (h + 1) % 5) THEN 0.9 ELSE 1 END AS DOUBLE)
      * CAST(CASE WHEN hits.id IS NOT NULL THEN 0.85 ELSE 1 END AS DOUBLE), 6) AS distance
  FROM wide LEFT JOIN hits USING (query_id, id) WHERE k <= 50
)"""


@register("hall_search_two_passes", f"{_SEARCH} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM scored")
def hall_search_two_passes(spark, root):
    turns = table(spark, root, "conversations")
    hall = lambda n: F.element_at(F.array(*map(F.lit, HALLS)), (n % 5 + 1).cast("int"))
    halls = turns.select(F.col("conv_id").alias("id")).distinct().withColumn("hall", hall(F.col("id")))
    asked = turns.where("role = 'user' AND conv_id % 20 = 0 AND text IS NOT NULL").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("question"))
    number = F.floor(F.col("query_id") / 20)
    return S.search(turns, halls, asked.withColumn("halls", F.array(hall(number), hall(number + 1))))
