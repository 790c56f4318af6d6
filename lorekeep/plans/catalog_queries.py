"""Catalog summaries, pages of records, and the topic graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.functions.where import where
from lorekeep.operators import catalog as C
from lorekeep.operators import texts as X
from lorekeep.operators import topics as G
from lorekeep.plans.registry import register

W = f"WITH {V.RECORDS_SQL}"
NOW = "2027-01-01"


@register("list_domains", f"{W} SELECT coalesce(nullif(domain, ''), 'unknown') AS domain, count(*) AS n FROM records GROUP BY 1")
def list_domains(spark, root):
    return C.count_by(V.records(spark, root), "domain")


@register("list_topics_in_domain", f"{W} SELECT topic, count(*) AS n FROM records WHERE domain = 'en' GROUP BY 1")
def list_topics_in_domain(spark, root):
    return C.count_by(V.records(spark, root).where(where({"domain": "en"})), "topic")


@register(
    "taxonomy_grouping_sets",
    f"""{W} SELECT domain, topic, count(*) AS n, CASE WHEN grouping(topic) = 1 THEN 2 WHEN grouping(domain) = 1 THEN 3 ELSE 1 END AS level
    FROM records GROUP BY GROUPING SETS ((domain, topic), (domain), (topic))""",
)
def taxonomy_grouping_sets(spark, root):
    return C.taxonomy(V.records(spark, root))


@register("migration_summary", f"{W} SELECT domain, topic, count(*) AS n FROM records GROUP BY 1, 2")
def migration_summary(spark, root):
    return C.count_by(V.records(spark, root), "domain", "topic")


@register("domain_activity", f"{W} SELECT domain, max(filed_at) AS latest FROM records GROUP BY 1")
def domain_activity(spark, root):
    return C.activity(V.records(spark, root))


@register("domain_brief", f"{W} SELECT domain, count(*) AS total, count(DISTINCT topic) AS topics, count(DISTINCT contributor) AS contributors, count(DISTINCT source_file) AS source_files FROM records GROUP BY 1")
def domain_brief(spark, root):
    return C.brief(V.records(spark, root))


@register("stale_domains", f"{W} SELECT domain, max(filed_at) AS latest FROM records GROUP BY 1 HAVING max(filed_at) < strftime(DATE '{NOW}' - 90, '%Y-%m-%d') ORDER BY 2, 1 LIMIT 10")
def stale_domains(spark, root):
    return C.stale(V.records(spark, root), NOW)


@register("top_domains", f"{W} SELECT domain, count(*) AS n FROM records GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_domains(spark, root):
    return C.top(V.records(spark, root), 3)


@register("recent_records", f"{W} SELECT id, filed_at, topic, substr(string_split(trim(document, ' '), chr(10))[1], 1, 80) AS gist FROM records ORDER BY filed_at DESC, id DESC LIMIT 5")
def recent_records(spark, root):
    return C.recent(V.records(spark, root))


@register("get_where_page", f"{W} SELECT id, topic, chunk_index FROM records WHERE domain = 'en' AND (topic = 'src0' OR chunk_index >= 500) ORDER BY id LIMIT 20 OFFSET 10")
def get_where_page(spark, root):
    condition = where({"domain": "en", "$or": [{"topic": "src0"}, {"chunk_index": {"$gte": 500}}]})
    return C.reads(V.records(spark, root), condition, 10, 20).select("id", "topic", "chunk_index")


@register("get_where_in_nin", f"{W} SELECT id FROM records WHERE domain IN ('en', 'de') AND topic NOT IN ('src0', 'src1') AND chunk_index <> 7")
def get_where_in_nin(spark, root):
    condition = where({"domain": {"$in": ["en", "de"]}, "topic": {"$nin": ["src0", "src1"]}, "chunk_index": {"$ne": 7}})
    return V.records(spark, root).where(condition).select("id")


@register("dedup_stats", f"{W} SELECT source_file, count(*) AS n, CAST(count(*) * 2 // 5 AS BIGINT) AS estimated FROM records GROUP BY 1 HAVING count(*) > 20")
def dedup_stats(spark, root):
    return C.estimated_duplicates(V.records(spark, root))


@register("dedup_groups", f"{W} SELECT source_file, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM records GROUP BY 1 HAVING count(*) >= 5")
def dedup_groups(spark, root):
    return X.source_groups(V.records(spark, root))


@register(
    "catalog_cards",
    f"""{W}, t AS (SELECT domain, topic, unnest(list_transform(regexp_extract_all(document, '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x))) AS token FROM records),
    c AS (SELECT domain, topic, token, count(*) AS n FROM t GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY n DESC, token) AS k FROM c)
    SELECT domain, topic, string_agg(token, ' ' ORDER BY k) AS top_tokens FROM r WHERE k <= 4 GROUP BY 1, 2""",
)
def catalog_cards(spark, root):
    return C.cards(V.records(spark, root))


_NODES = """nodes AS (
  SELECT topic, list_sort(list_distinct(list(domain))) AS domains, count(*) AS n, list_sort(list_reverse_sort(list_distinct(list(filed_at)))[1:5]) AS dates
  FROM records WHERE topic <> '' AND topic <> 'general' AND domain <> '' GROUP BY topic)"""
_EDGES = """edges AS (
  SELECT topic, domains[i] AS domain_a, domains[j] AS domain_b, n FROM nodes, unnest(range(1, len(domains) + 1)) AS a(i), unnest(range(1, len(domains) + 1)) AS b(j) WHERE i < j)"""


@register("topic_graph_nodes", f"{W}, {_NODES} SELECT topic, array_to_string(domains, ',') AS domains, n, array_to_string(dates, ',') AS dates FROM nodes")
def topic_graph_nodes(spark, root):
    return G.nodes(V.records(spark, root)).withColumn("domains", F.array_join("domains", ",")).withColumn("dates", F.array_join("dates", ","))


@register("topic_graph_edges", f"{W}, {_NODES}, {_EDGES} SELECT topic, domain_a, domain_b, n FROM edges")
def topic_graph_edges(spark, root):
    return G.edges(G.nodes(V.records(spark, root)))


@register(
    "bridges_curated",
    f"""{W}, {_NODES}, {_EDGES}, kept AS (SELECT * FROM edges WHERE NOT (topic = 'src1' AND domain_a = 'de' AND domain_b = 'en')),
    more AS (SELECT * FROM kept UNION ALL SELECT 'extra', 'de', 'en', 0)
    SELECT topic, domain_a, domain_b, CAST(n + CASE WHEN topic = 'src2' AND domain_a = 'en' AND domain_b = 'fr' THEN 100 ELSE 0 END AS BIGINT) AS rank_value
    FROM more ORDER BY rank_value DESC, topic, domain_a, domain_b LIMIT 50""",
)
def bridges_curated(spark, root):
    key = "topic string, domain_a string, domain_b string"
    deny = spark.createDataFrame([("src1", "de", "en")], key)
    allow = spark.createDataFrame([("extra", "de", "en")], key)
    boost = spark.createDataFrame([("src2", "en", "fr", 100)], key + ", boost long")
    return G.curated(G.edges(G.nodes(V.records(spark, root))), deny, allow, boost)


@register("graph_stats", f"{W}, {_NODES} SELECT count(*) AS topics, count(*) FILTER (len(domains) > 1) AS bridges, CAST(sum(len(domains) * (len(domains) - 1) // 2) AS BIGINT) AS edges FROM nodes")
def graph_stats(spark, root):
    return G.stats(G.nodes(V.records(spark, root)))


@register(
    "traverse_bfs",
    f"""{W}, {_NODES}, p AS (SELECT topic, unnest(domains) AS domain FROM nodes),
    one AS (SELECT DISTINCT b.topic FROM p a JOIN p b USING (domain) WHERE a.topic = 'src1'),
    two AS (SELECT DISTINCT b.topic FROM p a JOIN p b USING (domain) WHERE a.topic IN (SELECT topic FROM one)),
    h AS (SELECT topic, min(hop) AS hop FROM (SELECT 'src1' AS topic, 0 AS hop UNION ALL SELECT topic, 1 FROM one UNION ALL SELECT topic, 2 FROM two) GROUP BY 1)
    SELECT topic, hop, n FROM h JOIN nodes USING (topic) ORDER BY hop, n DESC, topic LIMIT 50""",
)
def traverse_bfs(spark, root):
    return G.traverse(G.nodes(V.records(spark, root)), "src1")
