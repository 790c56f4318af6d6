"""Facts found by rules, and their way from proposal to fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.operators import proposals as P
from lorekeep.plans.registry import register

AT = "2025-01-01"

#: A text for each part, in which its brand and size say something in every mood.
_TEXT = """'We switched from ' || b || ' to ' || k || '.' || chr(10) || 'Maybe we should try ' || b || '. ' || b || ' depends on ' || k
  || '. Does it use ' || b || '?' || chr(10) || 'The system use ' || k || ' and will stay. Later ' || b || ' replaced Old' || k || ' with New' || k || '!'"""
_NAMED = "SELECT p_partkey, 'part_' || p_partkey AS id, replace(p_brand, '#', '') AS b, 'K' || p_size AS k, p_type AS domain FROM part"

#: The sentences' facts, written down one by one.
_FACTS = f"""named AS ({_NAMED}), found AS (
  SELECT id, domain, domain AS subject, 'migrated_from' AS predicate, b AS object, 0.9 AS confidence, 'asserted' AS modality, 'We switched from ' || b || ' to ' || k || '.' AS evidence FROM named
  UNION ALL SELECT id, domain, domain, 'migrated_to', k, 0.9, 'asserted', 'We switched from ' || b || ' to ' || k || '.' FROM named
  UNION ALL SELECT id, domain, domain, 'uses', b, 0.55, 'hypothetical', 'Maybe we should try ' || b || '.' FROM named
  UNION ALL SELECT id, domain, b, 'depends_on', k, 0.84, 'asserted', b || ' depends on ' || k || '.' FROM named
  UNION ALL SELECT id, domain, domain, 'uses', k, 0.58, 'planned', 'The system use ' || k || ' and will stay.' FROM named
  UNION ALL SELECT id, domain, domain, 'migrated_from', 'Old' || k, 0.88, 'asserted', 'Later ' || b || ' replaced Old' || k || ' with New' || k || '!' FROM named
  UNION ALL SELECT id, domain, domain, 'migrated_to', 'New' || k, 0.88, 'asserted', 'Later ' || b || ' replaced Old' || k || ' with New' || k || '!' FROM named),
  proposals AS (SELECT 'cand_' || left(sha256(concat_ws(chr(0), subject, predicate, object, modality, 'positive', '', '', id, evidence, 'parts.txt', domain, b)), 16) AS candidate_id,
    found.*, 'proposed' AS status FROM found JOIN (SELECT id, b FROM named) USING (id))"""


def _records(spark, root):
    named = table(spark, root, "part").selectExpr("concat('part_', p_partkey) AS id", "replace(p_brand, '#', '') AS b", "concat('K', p_size) AS k", "p_type AS domain")
    return named.select("id", F.expr(_TEXT).alias("document"), "domain", F.col("b").alias("topic"), F.lit("parts.txt").alias("source_file"))


def _proposals(spark, root):
    return P.propose(P.extract(_records(spark, root)))


_HELD = "held AS (SELECT DISTINCT p_type AS subject, 'migrated_to' AS predicate, 'K' || p_size AS object, '2024-01-01' AS valid_from, NULL::VARCHAR AS valid_to FROM part WHERE p_size < 10)"


def _held(spark, root):
    """Facts that were there before: what each type moved to, by its small sizes."""
    small = table(spark, root, "part").where("p_size < 10")
    return small.selectExpr("p_type AS subject", "'migrated_to' AS predicate", "concat('K', p_size) AS object", "'2024-01-01' AS valid_from", "CAST(NULL AS STRING) AS valid_to").distinct()


@register(
    "kg_extract_rules",
    f"""WITH {_FACTS} SELECT id, 'preview_' || left(sha256(concat_ws(chr(0), predicate, subject, object, id)), 16) AS preview_id, subject, predicate, object, CAST(confidence AS DOUBLE) AS confidence, modality, evidence
    FROM found""",
)
def kg_extract_rules(spark, root):
    return P.extract(_records(spark, root)).select("id", "preview_id", "subject", "predicate", "object", "confidence", "modality", "evidence")


@register("kg_propose", f"WITH {_FACTS} SELECT candidate_id, subject, predicate, object, id AS source_id, status FROM proposals")
def kg_propose(spark, root):
    """Proposed twice: the second time changes nothing."""
    found = _proposals(spark, root)
    return P.merge(found, found).select("candidate_id", "subject", "predicate", "object", "source_id", "status")


@register("kg_proposals_page", f"WITH {_FACTS} SELECT candidate_id, predicate, CAST(confidence AS DOUBLE) AS confidence FROM proposals WHERE predicate = 'migrated_to' AND confidence >= 0.89 ORDER BY id, candidate_id LIMIT 20 OFFSET 10")
def kg_proposals_page(spark, root):
    return P.page(_proposals(spark, root), F.col("predicate") == "migrated_to", 0.89, 10, 20).select("candidate_id", "predicate", "confidence")


@register(
    "kg_proposal_conflicts",
    f"""WITH {_FACTS}, {_HELD}, h AS (SELECT subject, list_sort(list(object)) AS objects FROM held GROUP BY 1)
    SELECT candidate_id, CASE WHEN predicate = 'migrated_to' AND modality = 'asserted' THEN array_to_string(list_filter(coalesce(objects, []), lambda x: x <> object), ',') ELSE '' END AS conflicting
    FROM proposals LEFT JOIN h ON proposals.subject = h.subject""",
)
def kg_proposal_conflicts(spark, root):
    return P.with_conflicts(_proposals(spark, root), _held(spark, root)).select("candidate_id", F.array_join("conflicting", ",").alias("conflicting"))


@register("kg_reject", f"WITH {_FACTS} SELECT candidate_id, CASE WHEN confidence < 0.6 THEN 'rejected' ELSE 'proposed' END AS status, CASE WHEN confidence < 0.6 THEN '{AT}' END AS reviewed_at FROM proposals")
def kg_reject(spark, root):
    return P.reject(_proposals(spark, root), F.col("confidence") < 0.6, AT).select("candidate_id", "status", "reviewed_at")


@register(
    "kg_accept",
    f"""WITH {_FACTS}, {_HELD}, said AS (SELECT DISTINCT subject, object FROM proposals WHERE predicate = 'migrated_to' AND confidence = 0.9),
    closed AS (SELECT h.subject, predicate, h.object, valid_from, CASE WHEN h.subject IN (SELECT subject FROM said) AND (h.subject, h.object) NOT IN (SELECT (subject, object) FROM said) THEN '{AT}' END AS valid_to FROM held h)
    SELECT * FROM closed UNION ALL SELECT subject, 'migrated_to', object, '{AT}', NULL FROM said WHERE (subject, object) NOT IN (SELECT (subject, object) FROM closed WHERE valid_to IS NULL)""",
)
def kg_accept(spark, root):
    chosen = (F.col("predicate") == "migrated_to") & (F.col("confidence") == 0.9)
    return P.accept(_proposals(spark, root), _held(spark, root), chosen, AT, close_conflicts=True)[1]
