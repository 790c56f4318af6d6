"""Rule-based text operators and session measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.engine.session import table
from lorekeep.operators import texts as X
from lorekeep.plans.registry import register

W = f"WITH {V.RECORDS_SQL}"
TOPICS = {"english": ["the", "and", "with"], "french": ["les", "des", "pour"], "spanish": ["los", "que", "con"], "german": ["der", "die", "nicht"]}


@register("bounded_slices", f"{W} SELECT id, CAST(i AS INTEGER) AS slice_index, substr(document, CAST(i * 800 + 1 AS INTEGER), 800) AS content FROM records, unnest(range(0, (length(document) - 1) // 800 + 1)) AS u(i) WHERE length(trim(document, ' ')) > 30")
def bounded_slices(spark, root):
    return X.bounded_slices(V.records(spark, root))


@register(
    "exchange_chunks",
    """WITH n AS (SELECT *, sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations)
    SELECT conv_id, CAST(exchange AS BIGINT) AS exchange, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM n WHERE exchange > 0 GROUP BY 1, 2""",
)
def exchange_chunks(spark, root):
    return X.exchanges(table(spark, root, "conversations"))


def _topic_sql() -> str:
    counts = [" + ".join(f"CAST(contains(d, '{w}') AS INTEGER)" for w in words) for words in TOPICS.values()]
    scored = ", ".join(f"({c}) AS n{k}" for k, c in enumerate(counts))
    cases = " ".join(f"WHEN n{k} = m THEN '{name}'" for k, name in enumerate(TOPICS))
    return f"""{W}, a AS (SELECT id, lower(document) AS d FROM records), b AS (SELECT id, {scored} FROM a),
    c AS (SELECT *, greatest({", ".join(f"n{k}" for k in range(len(TOPICS)))}) AS m FROM b) SELECT id, CASE WHEN m = 0 THEN 'general' {cases} END AS topic FROM c"""


@register("convo_topic", _topic_sql())
def convo_topic(spark, root):
    return V.records(spark, root).select("id", X.keyword_topic(F.col("document"), TOPICS, None).alias("topic"))


@register("entity_candidates", f"{W}, w AS (SELECT unnest(regexp_extract_all(document, '[A-Z][a-z]{{2,19}}')) AS name FROM records) SELECT name, count(*) AS n FROM w WHERE name NOT IN ('The', 'And') GROUP BY 1 HAVING count(*) >= 3")
def entity_candidates(spark, root):
    return X.name_candidates(V.records(spark, root), 3, ("The", "And"))


@register(
    "session_adherence",
    f"""WITH {V.CALLS_SQL}, g AS (SELECT session_id, count(*) AS calls, count(*) FILTER (tool IN ('add_record', 'checkpoint')) AS writes, arg_max(tool, seq) AS last_tool,
      min(seq) FILTER (tool IN ('search', 'status')) AS fr, min(seq) FILTER (tool IN ('add_record', 'checkpoint')) AS fw FROM calls GROUP BY 1)
    SELECT session_id, calls, writes, last_tool, CASE WHEN fw IS NOT NULL THEN coalesce(fr < fw, false) END AS read_before_write, CASE WHEN fw IS NOT NULL THEN last_tool = 'checkpoint' END AS closed FROM g""",
)
def session_adherence(spark, root):
    return X.adherence(V.calls(spark, root), ["search", "status"], ["add_record", "checkpoint"], "checkpoint")


@register("save_trigger", "WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'user') SELECT conv_id, turn, CAST(nth AS INTEGER) AS nth FROM u WHERE nth % 2 = 0")
def save_trigger(spark, root):
    return X.save_triggers(table(spark, root, "conversations"), 2)


@register("session_documents", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS document FROM conversations WHERE role = 'user' GROUP BY 1")
def session_documents(spark, root):
    return X.session_documents(table(spark, root, "conversations"))


@register("edit_distance_pairs", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def edit_distance_pairs(spark, root):
    n = table(spark, root, "nation").select("n_name", "n_regionkey")
    pairs = n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "n_regionkey").where("a < b")
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance"))


@register(
    "token_f1",
    """WITH p AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM part),
    c AS (SELECT p_partkey, len(p) AS np, len(t) AS nt, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda x: x = w))))), 0) AS common FROM p)
    SELECT p_partkey, round(CASE WHEN common = 0 THEN 0.0 ELSE CAST(2.0 * common AS DOUBLE) / (np + nt) END, 6) AS f1 FROM c""",
)
def token_f1(spark, root):
    return table(spark, root, "part").select("p_partkey", F.round(X.token_f1(F.col("p_name"), F.col("p_type")), 6).alias("f1"))


@register(
    "eav_pivot",
    """WITH e AS (SELECT p_partkey AS id, 'name' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part)
    SELECT id, max(CASE WHEN key = 'name' THEN value END) AS document, count(*) FILTER (key <> 'name') AS attributes FROM e GROUP BY 1""",
)
def eav_pivot(spark, root):
    long = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.explode(F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand", F.lit("type"), "p_type")).alias("key", "value"))
    return X.pivot_attributes(long, "name")
