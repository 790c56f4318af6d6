"""Catalog cards written to files, and brought up to a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.engine.shared import new_folder
from lorekeep.operators import card_files as C
from lorekeep.plans.registry import register

_STOP = "(" + ", ".join(f"'{w}'" for w in C.STOP) + ")"
_CARDS = rf"""WITH {V.RECORDS_SQL}, held AS (
  SELECT domain, coalesce(nullif(topic, ''), 'general') AS room, coalesce(source_file, '') AS source_file, coalesce(document, '') AS document FROM records WHERE coalesce(domain, '') <> ''
), counts AS (
  SELECT domain, room, source_file, word, count(*) AS n FROM (SELECT *, lower(unnest(regexp_extract_all(document, '[A-Za-z0-9_]{{3,}}'))) AS word FROM held) WHERE word NOT IN {_STOP} GROUP BY ALL
), topics AS (
  SELECT domain, room, source_file, string_agg(word, ' ' ORDER BY k) AS topic FROM (SELECT *, row_number() OVER (PARTITION BY domain, room, source_file ORDER BY n DESC, word) AS k FROM counts) WHERE k <= 4 GROUP BY ALL
), spoken AS (
  SELECT domain, room, source_file, unnest(list_filter(regexp_split_to_array(document, '[^\p{{L}}\p{{M}}\p{{N}}_-]+'), lambda x: regexp_matches(x, '[A-Z]'))) AS run FROM held
), names AS (
  SELECT domain, room, source_file, w AS word, count(*) AS n FROM (
    SELECT domain, room, source_file, unnest(list_filter(regexp_split_to_array(run, '-'), lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9_]{{2,}}'))) AS w FROM spoken) GROUP BY ALL
), entities AS (
  SELECT domain, room, source_file, string_agg(word, ',' ORDER BY k) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY domain, room, source_file ORDER BY n DESC, lower(word), word) AS k FROM names) WHERE k <= 5 GROUP BY ALL
), cards AS (
  SELECT h.domain, h.room, h.source_file, h.records, coalesce(topic, h.room) AS topic, coalesce(entities, '') AS entities
  FROM (SELECT domain, room, source_file, count(*) AS records FROM held GROUP BY ALL) h LEFT JOIN topics USING (domain, room, source_file) LEFT JOIN entities USING (domain, room, source_file)
)"""


@register("card_files_refreshed", f"{_CARDS} SELECT * FROM cards")
def card_files_refreshed(spark, root):
    """Cards written when every third record lay in another domain, and some under another topic, then brought up to the records as they are."""
    records = V.records(spark, root)
    n = F.col("chunk_index")
    before = records.withColumn("domain", F.when(n % 3 == 0, "old").otherwise(F.col("domain"))).withColumn("topic", F.when(n % 5 == 1, "moved").otherwise(F.col("topic")))
    moved = (n % 3 == 0) | (n % 5 == 1)
    path = new_folder(spark, "cards")
    C.rebuild(before, path)
    C.refresh(records, before.where(moved).unionByName(records.where(moved)), path)
    return C.load(spark, path).withColumn("entities", F.array_join("entities", ","))


@register("card_files_of_domain", f"{_CARDS} SELECT * FROM cards WHERE domain = 'en'")
def card_files_of_domain(spark, root):
    path = new_folder(spark, "cards")
    C.rebuild(V.records(spark, root), path)
    return C.load(spark, path, "en").withColumn("entities", F.array_join("entities", ","))
