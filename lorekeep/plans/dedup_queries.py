"""Removal of near duplicates within sources."""

from __future__ import annotations

from lorekeep.engine import views as V
from lorekeep.operators import dedup
from lorekeep.plans.registry import register

# The loop over each source, one record a step: ``kept`` holds the numbers of those that stayed so far.
_LOOP = rf"""{V.RECORDS_SQL}, counted AS (
  SELECT *, count(*) OVER (PARTITION BY source_file) AS n, coalesce(length(document), 0) AS chars FROM records
), long AS (
  SELECT id, source_file, list_distinct(list_transform(regexp_extract_all(coalesce(document, ''), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: lower(x))) AS words,
         row_number() OVER (PARTITION BY source_file ORDER BY chars DESC, id) AS k
  FROM counted WHERE n >= 5 AND chars >= 20
), w AS (
  SELECT id, source_file, k, len(words) AS n, unnest(words) AS word FROM long
), met AS (
  SELECT b.id, a.k, count(*) AS c, any_value(a.n + b.n) AS s
  FROM w a JOIN w b ON a.source_file = b.source_file AND a.word = b.word AND a.k < b.k GROUP BY b.id, a.k
), near AS (
  SELECT id, list(k) AS before FROM met WHERE round((s - 2 * c) / (s - c), 6) < 0.15 GROUP BY id
), loop AS (
  SELECT source_file, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept, '' AS id, false AS stays FROM long WHERE k = 1
  UNION ALL
  SELECT long.source_file, long.k, CASE WHEN list_has_any(coalesce(before, []), kept) THEN kept ELSE list_append(kept, long.k) END,
         long.id, NOT list_has_any(coalesce(before, []), kept)
  FROM loop JOIN long ON long.source_file = loop.source_file AND long.k = loop.k + 1 LEFT JOIN near ON near.id = long.id
), decided AS (
  SELECT counted.id, counted.source_file, CASE WHEN n < 5 THEN 'unchecked' WHEN chars < 20 THEN 'short' WHEN stays THEN 'kept' ELSE 'duplicate' END AS decision
  FROM counted LEFT JOIN loop ON loop.id = counted.id
)"""
W = f"WITH RECURSIVE {_LOOP}"


@register("dedup_greedy", f"{W} SELECT id, source_file, decision FROM decided")
def dedup_greedy(spark, root):
    return dedup.near_duplicates(V.records(spark, root))


@register(
    "dedup_outcome",
    f"""{W} SELECT source_file, count(*) AS records, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision IN ('short', 'duplicate')) AS removed
    FROM decided WHERE decision <> 'unchecked' GROUP BY 1""",
)
def dedup_outcome(spark, root):
    return dedup.outcome(dedup.near_duplicates(dedup.in_scope(V.records(spark, root), source="SRC")))
