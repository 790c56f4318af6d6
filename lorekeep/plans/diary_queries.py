"""Diaries, the digest of a session, cards of sources, and bookkeeping of deletions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.engine.session import table
from lorekeep.operators import catalog as C
from lorekeep.operators import diary as D
from lorekeep.operators import sync as S
from lorekeep.plans.registry import register

#: Users' turns as entries of three agents, one an hour.
_ENTRIES = """entries AS (SELECT 'Agent ' || (conv_id % 3) AS agent, 'topic_' || (turn % 4) AS topic, text AS entry,
  strftime(DATE '2024-01-01' + CAST(conv_id % 400 AS INTEGER), '%Y-%m-%d') || 'T' || lpad(CAST(turn % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0') || ':00' AS filed_at
  FROM conversations WHERE role = 'user'),
  written AS (SELECT 'diary_wing_' || replace(lower(agent), ' ', '_') || '_' || replace(replace(replace(filed_at, '-', ''), ':', ''), 'T', '_') || '_' || left(sha256(substr(entry, 1, 50)), 12) AS id,
    agent, topic, entry, filed_at, left(filed_at, 10) AS date FROM entries)"""


def _written(spark, root):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 400).cast("int")).cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.concat(day, F.lit("T"), two(F.col("turn") % 24), F.lit(":"), two(F.col("conv_id") % 60), F.lit(":00"))
    said = table(spark, root, "conversations").where("role = 'user'")
    agent, topic = F.concat(F.lit("Agent "), (F.col("conv_id") % 3).cast("string")), F.concat(F.lit("topic_"), (F.col("turn") % 4).cast("string"))
    return D.write(said.select(agent.alias("agent"), topic.alias("topic"), F.col("text").alias("entry"), at.alias("filed_at")))


@register("diary_write", f"WITH {_ENTRIES} SELECT id, topic AS subject, date FROM written")
def diary_write(spark, root):
    return _written(spark, root).select("id", "subject", "date")


@register("diary_read", f"WITH {_ENTRIES} SELECT id, date, filed_at, topic AS subject, entry AS document FROM written WHERE agent = 'Agent 1' ORDER BY filed_at DESC, id DESC LIMIT 5")
def diary_read(spark, root):
    return D.read(_written(spark, root), "Agent 1", 5)


@register("diary_newest", f"WITH {_ENTRIES} SELECT date, topic AS subject FROM written ORDER BY filed_at DESC, topic LIMIT 1")
def diary_newest(spark, root):
    return D.newest(_written(spark, root))


@register(
    "digest_global",
    f"""WITH {V.RECORDS_SQL}, d AS (SELECT contributor AS domain, count(*) AS n, max(filed_at) AS latest FROM records GROUP BY 1),
    t AS (SELECT *, row_number() OVER (ORDER BY n DESC, domain) AS k FROM d)
    SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS domains, sum(n) || ' records' || chr(10) || string_agg('- ' || domain || ' — ' || n || ' records · last ' || latest, chr(10) ORDER BY k) FILTER (k <= 5)
      || CASE WHEN count(*) > 5 THEN chr(10) || '(+' || (count(*) - 5) || ' more)' ELSE '' END AS section FROM t""",
)
def digest_global(spark, root):
    return D.global_section(V.records(spark, root).withColumn("domain", F.col("contributor")), 5)


@register(
    "digest_trim",
    f"""WITH {V.RECORDS_SQL}, l AS (SELECT id, document, string_split(document, chr(10)) AS lines FROM records),
    u AS (SELECT id, unnest(lines[1:198]) AS line, generate_subscripts(lines[1:198], 1) AS k FROM l),
    c AS (SELECT id, line, k, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY id ORDER BY k) - 1 AS used FROM u),
    t AS (SELECT id, string_agg(line, chr(10) ORDER BY k) AS kept FROM c WHERE used <= 25600 - 20 GROUP BY 1)
    SELECT l.id, sha256(CASE WHEN len(lines) <= 200 AND octet_length(encode(document)) <= 25600 THEN document ELSE coalesce(kept, '') || chr(10) || chr(10) || '[digest truncated]' END) AS digest
    FROM l LEFT JOIN t ON l.id = t.id""",
)
def digest_trim(spark, root):
    return V.records(spark, root).select("id", F.sha2(D.trim(F.col("document")), 256).alias("digest"))


_PARTS = "parts AS (SELECT p_brand AS source_file, p_name || ' for Acme-' || p_size || ' and Zed by ' || p_type || ', ' || replace(p_brand, '#', '') AS document FROM part)"


def _parts(spark, root):
    return table(spark, root, "part").selectExpr("p_brand AS source_file", "concat(p_name, ' for Acme-', p_size, ' and Zed by ', p_type, ', ', replace(p_brand, '#', '')) AS document")


def _card_sql(words: str, tie: str, most: int, mark: str, name: str) -> str:
    return f"""WITH {_PARTS}, t AS (SELECT source_file, unnest({words}) AS token FROM parts), c AS (SELECT source_file, token, count(*) AS n FROM t GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, {tie}, token) AS k FROM c)
    SELECT source_file, string_agg(token, '{mark}' ORDER BY k) AS {name} FROM r WHERE k <= {most} GROUP BY 1"""


@register("card_tokens_by_source", _card_sql("list_transform(regexp_extract_all(document, '[A-Za-z0-9_]{2,}'), lambda x: lower(x))", "token", 4, " ", "top_tokens"))
def card_tokens_by_source(spark, root):
    return C.cards(_parts(spark, root), by=("source_file",))


@register("card_entities_by_source", _card_sql(r"regexp_extract_all(document, '\b[A-Z][A-Za-z0-9_-]{2,}\b')", "lower(token)", 5, ",", "top_entities"))
def card_entities_by_source(spark, root):
    return C.card_entities(_parts(spark, root), by=("source_file",))


@register("tombstones_made", f"WITH {V.RECORDS_SQL} SELECT DISTINCT 'tombstone:' || source_file AS id, source_file AS target, '2025-04-15' AS grace_until FROM records")
def tombstones_made(spark, root):
    return S.tombstones(V.records(spark, root).select(F.col("source_file").alias("id")), "keeper", "merged", "2025-01-15").select("id", "target", "grace_until")


@register("merged_vector", "WITH v AS (SELECT event_type AS node_id, max(event_id) AS seq FROM events GROUP BY 1 UNION ALL SELECT event_type, max(user_id) * 90 FROM events GROUP BY 1) SELECT node_id, max(seq) AS seq FROM v WHERE seq > 0 GROUP BY 1")
def merged_vector(spark, root):
    events = table(spark, root, "events").withColumnRenamed("event_type", "node_id")
    return S.merged_vector(events.select("node_id", F.col("event_id").alias("seq")), events.select("node_id", (F.col("user_id") * 90).alias("seq")))
