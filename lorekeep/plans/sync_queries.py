"""Change capture, merge, soft deletion and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.engine.shared import new_folder
from lorekeep.operators import exchange
from lorekeep.operators import sync as S
from lorekeep.plans.registry import register
from lorekeep.sources.versions import VersionedTable

_STAMPED = f"""{V.CHANGES_SQL}, stamped AS (
  SELECT event_id AS id, node_id, row_number() OVER (PARTITION BY node_id ORDER BY event_id) AS seq, updated_at, record_id, value FROM changes)"""
W = f"WITH {_STAMPED}"


def _stamped(spark, root):
    rows = S.stamp(V.changes(spark, root), "event_id")
    return rows.select(F.col("event_id").alias("id"), "node_id", "seq", "updated_at", "record_id", "value")


@register("seq_stamp", f"{W} SELECT id, node_id, seq FROM stamped")
def seq_stamp(spark, root):
    return _stamped(spark, root).select("id", "node_id", "seq")


@register("version_vector", f"{W} SELECT node_id, max(seq) AS seq FROM stamped GROUP BY 1")
def version_vector(spark, root):
    return S.version_vector(_stamped(spark, root))


def _remote_vector(spark):
    return spark.createDataFrame([("click", 40), ("view", 100)], "node_id string, seq long")


_UNSEEN = "unseen AS (SELECT * FROM stamped WHERE seq > CASE node_id WHEN 'click' THEN 40 WHEN 'view' THEN 100 ELSE 0 END)"


@register("changes_since", f"{W}, {_UNSEEN} SELECT id, node_id, seq FROM unseen")
def changes_since(spark, root):
    return S.unseen(_stamped(spark, root), _remote_vector(spark)).select("id", "node_id", "seq")


@register("changes_page", f"{W}, {_UNSEEN} SELECT id, node_id, seq FROM unseen ORDER BY id LIMIT 30 OFFSET 60")
def changes_page(spark, root):
    return S.page(S.unseen(_stamped(spark, root), _remote_vector(spark)), 60, 30).select("id", "node_id", "seq")


_REPLICAS = """
  ranked AS (SELECT record_id AS id, node_id, seq, updated_at, value, id <= 600 AS first_half,
    row_number() OVER (PARTITION BY record_id, id <= 600 ORDER BY updated_at DESC, node_id DESC, seq DESC) AS k FROM stamped),
  l AS (SELECT * FROM ranked WHERE first_half AND k = 1), r AS (SELECT * FROM ranked WHERE NOT first_half AND k = 1),
  merged AS (SELECT coalesce(l.id, r.id) AS id,
      CASE WHEN l.id IS NULL THEN 'new' WHEN r.id IS NULL THEN 'local' WHEN (r.updated_at, r.node_id) > (l.updated_at, l.node_id) THEN 'updated' ELSE 'kept' END AS outcome,
      l.node_id AS ln, r.node_id AS rn, l.updated_at AS lu, r.updated_at AS ru FROM l FULL JOIN r ON l.id = r.id)"""


def _merged(spark, root):
    rows = _stamped(spark, root)
    half = lambda c: S.latest(rows.where(c).select(F.col("record_id").alias("id"), "node_id", "seq", "updated_at"))
    return S.merge(half("id <= 600"), half("id > 600"))


@register(
    "lww_merge",
    f"{W}, {_REPLICAS} SELECT id, outcome, CASE WHEN outcome IN ('new', 'updated') THEN rn ELSE ln END AS node_id, CASE WHEN outcome IN ('new', 'updated') THEN ru ELSE lu END AS updated_at FROM merged",
)
def lww_merge(spark, root):
    return _merged(spark, root).select("id", "outcome", "node_id", "updated_at")


@register("merge_counts", f"{W}, {_REPLICAS} SELECT outcome, count(*) AS n FROM merged GROUP BY 1")
def merge_counts(spark, root):
    return _merged(spark, root).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register(
    "upsert_records",
    f"""{W}, u AS (SELECT record_id AS id, value, row_number() OVER (PARTITION BY record_id ORDER BY id DESC) AS k FROM stamped WHERE id > 500),
    base AS (SELECT record_id AS id, value, row_number() OVER (PARTITION BY record_id ORDER BY id) AS k FROM stamped WHERE id <= 500)
    SELECT id, value FROM base WHERE k = 1 AND id NOT IN (SELECT id FROM u) UNION ALL SELECT id, value FROM u WHERE k = 1""",
)
def upsert_records(spark, root):
    rows = _stamped(spark, root)
    base = rows.where("id <= 500").groupBy("record_id").agg(F.min_by("value", "id").alias("value"), F.min("id").alias("at")).withColumnRenamed("record_id", "id")
    batch = rows.where("id > 500").select(F.col("record_id").alias("id"), "value", F.col("id").alias("at"))
    return S.upsert(base, batch, "at").select("id", "value")


_TOMBS = "tombs AS (SELECT id AS target, CASE WHEN chunk_index % 7 = 1 THEN NULL ELSE strftime(DATE '2024-06-01' + CAST(chunk_index AS INTEGER), '%Y-%m-%d') END AS grace_until FROM records WHERE topic = 'src2')"
WT = f"WITH {V.RECORDS_SQL}, {_TOMBS}"
NOW = "2025-01-15"


def _tombstones(spark, root):
    records = V.records(spark, root).where("topic = 'src2'")
    until = F.date_add(F.lit("2024-06-01").cast("date"), F.col("chunk_index").cast("int")).cast("string")
    return records.select(F.col("id").alias("target"), F.when(F.col("chunk_index") % 7 != 1, until).alias("grace_until"))


@register("tombstone_visible", f"{WT} SELECT id FROM records WHERE id NOT IN (SELECT target FROM tombs WHERE grace_until IS NULL OR grace_until > '{NOW}')")
def tombstone_visible(spark, root):
    return S.visible(V.records(spark, root), S.active_tombstones(_tombstones(spark, root), NOW)).select("id")


@register("gc_pending", f"{WT} SELECT target FROM tombs WHERE grace_until <= '{NOW}'")
def gc_pending(spark, root):
    return S.pending(_tombstones(spark, root), NOW).select("target")


@register("gc_collect", f"{WT} SELECT id FROM records WHERE id NOT IN (SELECT target FROM tombs WHERE grace_until <= '{NOW}' AND target IN (SELECT id FROM records WHERE contributor LIKE '%_1'))")
def gc_collect(spark, root):
    requested = V.records(spark, root).where("contributor LIKE '%_1'").select("id")
    return S.collect_garbage(V.records(spark, root), _tombstones(spark, root), requested, NOW).select("id")


@register("content_hash_ids", f"WITH {V.RECORDS_SQL} SELECT id, 'record_' || domain || '_' || topic || '_' || left(sha256(domain || chr(0) || topic || chr(0) || document), 24) AS content_id FROM records")
def content_hash_ids(spark, root):
    return V.records(spark, root).select("id", S.content_id(F.col("domain"), F.col("topic"), F.col("document")).alias("content_id"))


# Two replicas with the events up to 300 in common; later ones were written at the first for clicks and views, else at the second.
_MET = """
  placed AS (SELECT record_id AS id, node_id, seq, updated_at, value, id <= 300 OR node_id IN ('click', 'view') AS in_a, id <= 300 OR node_id NOT IN ('click', 'view') AS in_b FROM stamped),
  a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, node_id DESC, seq DESC) AS k FROM placed WHERE in_a) WHERE k = 1),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, node_id DESC, seq DESC) AS k FROM placed WHERE in_b) WHERE k = 1)"""


def _replicas(spark, root):
    rows = _stamped(spark, root)
    here = {"a": F.col("node_id").isin("click", "view"), "b": ~F.col("node_id").isin("click", "view")}
    tables = []
    for name, own in here.items():
        placed = rows.where((F.col("id") <= 300) | own).select(F.col("record_id").alias("id"), "node_id", "seq", "updated_at", "value")
        tables.append(VersionedTable(spark, new_folder(spark, f"replica-{name}")))
        tables[-1].write(S.latest(placed), 0)
    return tables


@register(
    "sync_converged",
    f"""{W}, {_MET}, best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, node_id DESC, seq DESC) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
    SELECT replica, id, node_id, seq, updated_at, value FROM best, (VALUES ('a'), ('b')) AS r(replica) WHERE n = 1""",
)
def sync_converged(spark, root):
    """Both replicas after one session."""
    a, b = _replicas(spark, root)
    exchange.synchronise(a, b)
    return a.read().withColumn("replica", F.lit("a")).unionByName(b.read().withColumn("replica", F.lit("b")))


_VECTORS = """
  va AS (SELECT node_id, max(seq) AS seq FROM a GROUP BY 1), vb AS (SELECT node_id, max(seq) AS seq FROM b GROUP BY 1),
  push AS (SELECT a.* FROM a LEFT JOIN vb USING (node_id) WHERE a.seq > coalesce(vb.seq, 0)),
  pushed AS (SELECT count(*) AS sent, count(*) FILTER (b.id IS NULL OR (push.updated_at, push.node_id, push.seq) > (b.updated_at, b.node_id, b.seq)) AS accepted FROM push LEFT JOIN b USING (id))"""


@register("sync_pushed", f"{W}, {_MET}, {_VECTORS} SELECT sent, accepted, sent - accepted AS rejected FROM pushed")
def sync_pushed(spark, root):
    """What the push of a session moved."""
    pushed, _ = exchange.synchronise(*_replicas(spark, root))
    return spark.createDataFrame([(pushed.sent, pushed.accepted, pushed.rejected)], "sent long, accepted long, rejected long")


@register("changes_count", f"{W}, {_UNSEEN} SELECT count(*) AS n FROM unseen")
def changes_count(spark, root):
    return S.unseen(_stamped(spark, root), _remote_vector(spark)).agg(F.count(F.lit(1)).alias("n"))
