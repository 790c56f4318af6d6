"""Boosts of distances by what a question says, and measures of answers and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.engine.session import table
from lorekeep.functions import boosts as B
from lorekeep.operators import retrieval as R
from lorekeep.plans.registry import register

#: Each user's turn as a question that quotes the start of the turn after it, which is the text that it may find.
_ASKED = "concat('Did Anna say \"', substr(b.text, 1, 20), '\" or ''', substr(a.text, 3, 9), ''' to Robert? ', a.text)"
_TURNS = f"asked AS (SELECT a.conv_id, a.turn, {_ASKED} AS question, concat(b.text, CASE WHEN a.conv_id % 2 = 0 THEN ' anna' ELSE '' END) AS document FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


def _asked(spark, root):
    turns = table(spark, root, "conversations")
    a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("said"))
    b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    joined = a.join(b, ["conv_id", "turn"])
    question = F.concat(F.lit('Did Anna say "'), F.substring("answer", 1, 20), F.lit("\" or '"), F.substring("said", 3, 9), F.lit("' to Robert? "), "said")
    return joined.select("conv_id", "turn", question.alias("question"), F.concat("answer", F.when(F.col("conv_id") % 2 == 0, " anna").otherwise("")).alias("document"))


_PHRASES = "list_filter(list_transform(list_concat(regexp_extract_all(question, '''([^'']{3,60})''', 1), regexp_extract_all(question, '\"([^\"]{3,60})\"', 1)), lambda p: trim(p, ' ')), lambda p: length(p) >= 3)"
_NAMES = f"list_filter(list_distinct(list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,15}}'))), lambda n: n NOT IN {B.NOT_NAMES})"


@register(
    "fusion_phrases_names",
    f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, lower(document) AS low, {_PHRASES} AS phrases, {_NAMES} AS names FROM asked),
    s AS (SELECT *, CASE WHEN len(phrases) = 0 THEN 0.0 ELSE len(list_filter(phrases, lambda p: contains(low, lower(p)))) / len(phrases) END AS p,
      CASE WHEN len(names) = 0 THEN 0.0 ELSE len(list_filter(names, lambda n: contains(low, lower(n)))) / len(names) END AS n FROM t)
    SELECT conv_id, turn, CAST(len(phrases) AS INTEGER) AS phrases, CAST(len(names) AS INTEGER) AS names, round(CAST(0.8 AS DOUBLE) * (1 - CAST(0.6 AS DOUBLE) * p) * (1 - CAST(0.4 AS DOUBLE) * n), 6) AS fused FROM s""",
)
def fusion_phrases_names(spark, root):
    phrases, names, document = B.quoted(F.col("question")), B.person_names(F.col("question")), F.col("document")
    terms = _asked(spark, root).select("conv_id", "turn", "document", phrases.alias("p"), names.alias("n"))
    fused = B.fused(F.lit(0.8), F.lit(0.0), B.share(F.col("p"), document), B.share(F.col("n"), document))
    return terms.select("conv_id", "turn", F.size("p").alias("phrases"), F.size("n").alias("names"), F.round(fused, 6).alias("fused"))


_RANKED = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q, label AS q_label FROM embeddings WHERE vec_id % 20 = 0),
  scored AS (SELECT query_id, q_label, vec_id, label, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM embeddings JOIN q ON vec_id <> query_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM scored)"""


def _found(spark, root, k):
    vectors = V.vectors(spark, root)
    queries = vectors.where("vec_id % 20 = 0")
    top = R.dense_top_k(vectors, queries.selectExpr("vec_id AS query_id", "embedding AS query"), k)
    return top.join(queries.selectExpr("vec_id AS query_id", "label AS q_label"), "query_id")


@register(
    "fusion_same_room",
    f"WITH {_RANKED} SELECT query_id, vec_id, round(CASE WHEN label = q_label THEN distance * CAST(0.8 AS DOUBLE) ELSE distance END, 6) AS fused FROM ranked WHERE rank <= 10",
)
def fusion_same_room(spark, root):
    return _found(spark, root, 10).select("query_id", "vec_id", F.round(B.room_distance(F.col("distance"), F.col("label"), F.col("q_label")), 6).alias("fused"))


@register(
    "hit_by_category",
    f"""WITH {_RANKED}, h AS (SELECT query_id, any_value(q_label) AS category, bool_or(label = q_label) AS hit FROM ranked WHERE rank <= 5 GROUP BY 1)
    SELECT category, count(*) AS queries, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM h GROUP BY 1""",
)
def hit_by_category(spark, root):
    hits = _found(spark, root, 5).groupBy("query_id").agg(F.any_value("q_label").alias("category"), F.bool_or(F.col("label") == F.col("q_label")).alias("hit"))
    return hits.groupBy("category").agg(F.count(F.lit(1)).alias("queries"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("rate"))


@register(
    "evidence_recall",
    """WITH e AS (SELECT user_id, event_id, 'D' || (event_id % 7) || ':' || (event_id % 3) AS e, 'sess_' || user_id || '_turn_x_turn_' || event_id AS corpus FROM events),
    g AS (SELECT user_id, list(e ORDER BY event_id) AS evidence, list(e ORDER BY event_id) FILTER (event_id % 2 = 0) AS retrieved, min(corpus) AS corpus FROM e GROUP BY 1)
    SELECT user_id, round(len(list_filter(evidence, lambda x: list_contains(coalesce(retrieved, []), x))) / len(evidence), 6) AS recall,
      array_to_string(list_sort(list_distinct(list_transform(evidence, lambda x: 'session_' || regexp_extract(x, 'D(\\d+):', 1)))), ',') AS sessions, regexp_replace(corpus, '_turn_[0-9]+$', '') AS session FROM g""",
)
def evidence_recall(spark, root):
    piece = F.concat(F.lit("D"), (F.col("event_id") % 7).cast("string"), F.lit(":"), (F.col("event_id") % 3).cast("string"))
    corpus = F.concat(F.lit("sess_"), F.col("user_id").cast("string"), F.lit("_turn_x_turn_"), F.col("event_id").cast("string"))
    said = table(spark, root, "events").select("user_id", "event_id", piece.alias("e"), corpus.alias("corpus"))
    grouped = said.groupBy("user_id").agg(F.collect_list("e").alias("evidence"), F.collect_list(F.when(F.col("event_id") % 2 == 0, F.col("e"))).alias("retrieved"), F.min("corpus").alias("corpus"))
    return grouped.select(
        "user_id",
        F.round(B.evidence_recall(F.col("retrieved"), F.col("evidence")), 6).alias("recall"),
        F.array_join(F.sort_array(B.evidence_sessions(F.col("evidence"))), ",").alias("sessions"),
        B.session_of(F.col("corpus")).alias("session"),
    )


@register(
    "normal_answers",
    r"""WITH a AS (
      SELECT p_partkey, 'The ' || p_name || ', and a (' || p_brand || ') for an ' || p_type || '!' AS answer FROM part
    )
    SELECT p_partkey, trim(lower(regexp_replace(trim(regexp_replace(regexp_replace(replace(answer, ',', ''), '\b(a|an|the|and)\b', ' ', 'g'), '\s+', ' ', 'g')), '[[:punct:]]', '', 'g'))) AS answer
    FROM a""",
)
def normal_answers(spark, root):
    answer = F.concat(F.lit("The "), "p_name", F.lit(", and a ("), "p_brand", F.lit(") for an "), "p_type", F.lit("!"))
    return table(spark, root, "part").select("p_partkey", B.normal_answer(answer).alias("answer"))
