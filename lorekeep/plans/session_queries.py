"""Conversations written one after the other into a few text files, and split into sessions again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.engine.shared import new_folder
from lorekeep.plans.registry import register
from lorekeep.sources import sessions as S

HEADER, FILES = "=== session v", 5


def _split(spark, root):
    turns = table(spark, root, "conversations").where("text IS NOT NULL").withColumn("f", F.col("conv_id") % FILES)
    said = turns.select("f", "conv_id", "turn", F.posexplode(F.split(F.concat(F.when(F.col("role") == "user", "> ").otherwise(""), "text"), r"\r\n|\r|\n")).alias("k", "value"))
    heads = turns.select("f", "conv_id").distinct().select("f", "conv_id", F.lit(-1).cast("long").alias("turn"), F.lit(-1).alias("k"), F.concat(F.lit(HEADER), "conv_id").alias("value"))
    path = new_folder(spark, "sessions")
    said.withColumn("turn", F.col("turn").cast("long")).unionByName(heads).repartition("f").sortWithinPartitions("f", "conv_id", "turn", "k").select("f", "value").write.partitionBy("f").text(path)
    found = S.sessions(S.lines(spark, f"{path}/f=*"), HEADER)
    return found.withColumn("file", F.regexp_extract("file", r"/f=(-?\d+)/", 1).cast("long"))


_SESSIONS = rf"""said AS (
  SELECT conv_id % {FILES} AS f, conv_id, turn, regexp_split_to_array(CASE WHEN role = 'user' THEN '> ' ELSE '' END || text, '\r\n|\r|\n') AS parts
  FROM conversations WHERE text IS NOT NULL
), line AS (
  SELECT f, conv_id, turn, unnest(range(len(parts))) AS k, unnest(parts) AS value FROM said
  UNION ALL SELECT DISTINCT f, conv_id, -1, -1, '{HEADER}' || conv_id FROM said
), marked AS (
  SELECT *, contains(value, '{HEADER}') AND NOT bool_or(contains(value, 'Ctrl+E') OR contains(value, 'previous messages'))
    OVER (PARTITION BY f ORDER BY conv_id, turn, k ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS begins FROM line
), placed AS (
  SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY f ORDER BY conv_id, turn, k) - 1 AS session, count(*) FILTER (begins) OVER (PARTITION BY f) AS n FROM marked
)"""


@register(
    "session_split",
    f"""WITH {_SESSIONS} SELECT f AS file, CAST(session AS INTEGER) AS session, count(*) AS lines, sha256(string_agg(value, chr(10) ORDER BY conv_id, turn, k)) AS text_sha256
    FROM placed WHERE session >= 0 AND n >= 2 GROUP BY f, session HAVING count(*) >= 10""",
)
def session_split(spark, root):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return _split(spark, root).groupBy("file", "session").agg(F.count(F.lit(1)).alias("lines"), F.sha2(text, 256).alias("text_sha256"))


@register(
    "session_subjects",
    rf"""WITH {_SESSIONS}, asked AS (
      SELECT f, session, conv_id, turn, k, trim(substr(value, 3), ' ') AS q FROM placed WHERE starts_with(value, '> ') AND session >= 0 AND n >= 2
    ), first AS (
      SELECT f, session, arg_min(q, (conv_id, turn, k)) AS q FROM asked WHERE length(q) > 5 AND NOT regexp_matches(q, '^(?:\./|cd |ls |python|bash|git |cat |source |export |claude|./activate)') GROUP BY f, session
    ), long AS (
      SELECT f, session, count(*) AS size FROM placed WHERE session >= 0 AND n >= 2 GROUP BY f, session HAVING count(*) >= 10
    )
    SELECT f AS file, CAST(session AS INTEGER) AS session, size, coalesce(left(regexp_replace(trim(regexp_replace(q, '[^\p{{L}}\p{{M}}\p{{N}}_\s-]', '', 'g'), ' '), '\s+', '-', 'g'), 60), 'session') AS subject
    FROM long LEFT JOIN first USING (f, session)""",
)
def session_subjects(spark, root):
    return S.described(_split(spark, root), []).select("file", "session", "size", "subject")
