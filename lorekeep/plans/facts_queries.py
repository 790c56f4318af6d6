"""Temporal facts and their proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.operators import facts as K
from lorekeep.plans.registry import register

W = f"WITH {V.FACTS_SQL}"
NAME = "Customer#000000001"
COLUMNS = "fact_id, subject, predicate, object, valid_from, valid_to"


@register("kg_query_outgoing", f"{W} SELECT {COLUMNS} FROM facts WHERE lower(subject) = lower('{NAME}')")
def kg_query_outgoing(spark, root):
    return K.outgoing(V.facts(spark, root), NAME)


@register("kg_query_both", f"{W} SELECT {COLUMNS}, 'outgoing' AS direction FROM facts WHERE subject = 'F' UNION ALL SELECT {COLUMNS}, 'incoming' FROM facts WHERE object = 'F'")
def kg_query_both(spark, root):
    return K.both_ways(V.facts(spark, root), "F")


@register("kg_query_as_of", f"{W} SELECT {COLUMNS} FROM facts WHERE valid_from <= '1995-06-15' AND (valid_to IS NULL OR valid_to >= '1995-06-15')")
def kg_query_as_of(spark, root):
    return V.facts(spark, root).where(K.valid_at("1995-06-15"))


@register("kg_relationship", f"{W} SELECT {COLUMNS} FROM facts WHERE predicate = 'ordered_1' AND valid_from <= '1996-01-01' AND (valid_to IS NULL OR valid_to >= '1996-01-01')")
def kg_relationship(spark, root):
    return K.relationship(V.facts(spark, root), "Ordered 1", "1996-01-01")


@register("kg_timeline", f"{W} SELECT {COLUMNS} FROM facts ORDER BY valid_from ASC NULLS LAST, fact_id LIMIT 100")
def kg_timeline(spark, root):
    return K.timeline(V.facts(spark, root))


@register(
    "kg_stats",
    f"""{W} SELECT (SELECT count(*) FROM (SELECT DISTINCT replace(lower(x), ' ', '_') FROM (SELECT subject AS x FROM facts UNION ALL SELECT object FROM facts))) AS entities,
    count(*) AS facts, count(*) FILTER (valid_to IS NULL) AS "current", count(*) FILTER (valid_to IS NOT NULL) AS expired,
    string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates FROM facts""",
)
def kg_stats(spark, root):
    return K.stats(V.facts(spark, root))


@register("kg_invalidate", f"{W} SELECT fact_id, subject, predicate, object, valid_from, CASE WHEN predicate = 'ordered_2' AND valid_to IS NULL THEN '1999-01-01' ELSE valid_to END AS valid_to FROM facts")
def kg_invalidate(spark, root):
    return K.invalidate(V.facts(spark, root), F.col("predicate") == "ordered_2", "1999-01-01")


@register(
    "kg_add_idempotent",
    f"""{W}, new AS (SELECT DISTINCT subject, replace(lower('Ordered 1'), ' ', '_') AS predicate, object FROM facts)
    SELECT subject, predicate, object FROM new WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.subject = new.subject AND f.predicate = new.predicate AND f.object = new.object AND f.valid_to IS NULL)""",
)
def kg_add_idempotent(spark, root):
    facts = V.facts(spark, root)
    return K.add(facts, facts.select("subject", F.lit("Ordered 1").alias("predicate"), "object")).select("subject", "predicate", "object")


@register(
    "kg_conflicts",
    f"""{W}, held AS (SELECT DISTINCT subject, predicate, object AS held FROM facts WHERE valid_to IS NULL)
    SELECT fact_id, f.subject, f.predicate, object, coalesce(string_agg(DISTINCT CASE WHEN held <> object THEN held END, ',' ORDER BY CASE WHEN held <> object THEN held END), '') AS conflicting
    FROM facts f LEFT JOIN held h ON f.subject = h.subject AND f.predicate = h.predicate GROUP BY 1, 2, 3, 4""",
)
def kg_conflicts(spark, root):
    facts = V.facts(spark, root)
    return K.conflicts(facts.select("fact_id", "subject", "predicate", "object"), facts)


@register("kg_candidates_page", f"{W} SELECT fact_id, subject, object FROM facts WHERE predicate = 'ordered_3' AND valid_to IS NULL ORDER BY valid_from, fact_id LIMIT 50 OFFSET 25")
def kg_candidates_page(spark, root):
    open_facts = V.facts(spark, root).where("predicate = 'ordered_3' AND valid_to IS NULL")
    return open_facts.orderBy("valid_from", "fact_id").offset(25).limit(50).select("fact_id", "subject", "object")
