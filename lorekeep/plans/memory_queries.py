"""Memories, summaries, chunks and cleaned queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.engine.session import table
from lorekeep.functions import memories as M
from lorekeep.functions import summary as S
from lorekeep.functions.search_text import sanitize
from lorekeep.operators import chunks as K
from lorekeep.plans.registry import register

W = f"WITH {V.RECORDS_SQL}"


def _hits_sql(kind: str) -> str:
    counted = (f"len(regexp_extract_all(low, '{m.replace(chr(39), chr(39) * 2)}'))" for m in M.MARKERS[kind])
    return f"CAST({' + '.join(counted)} AS INTEGER) AS {kind}"


@register("memory_marker_hits", f"{W}, l AS (SELECT id, lower(document) AS low FROM records) SELECT id, {', '.join(map(_hits_sql, M.MARKERS))} FROM l")
def memory_marker_hits(spark, root):
    low = V.records(spark, root).select("id", F.lower("document").alias("low"))
    return low.select("id", *(M.marker_hits(F.col("low"), k).alias(k) for k in M.MARKERS))


def _words_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@register(
    "text_sentiment",
    f"""{W}, w AS (SELECT id, list_distinct(regexp_extract_all(lower(document), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM records),
    c AS (SELECT id, len(list_intersect(w, {_words_sql(M.POSITIVE)})) AS p, len(list_intersect(w, {_words_sql(M.NEGATIVE)})) AS n FROM w)
    SELECT id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS mood FROM c""",
)
def text_sentiment(spark, root):
    return V.records(spark, root).select("id", M.sentiment(F.col("document")).alias("mood"))


@register("extract_memories")
def extract_memories(spark, root):
    return M.memories(V.records(spark, root))


def _signals_sql(codes: dict[str, str]) -> str:
    """The first three codes: each counts where its first signal is found, unless an earlier signal gave it."""
    found = "[" + ", ".join(f"CASE WHEN contains(low, '{s}') THEN '{c}' END" for s, c in codes.items()) + "]"
    kept = f"list_filter({found}, lambda x: x IS NOT NULL)"
    return f"array_to_string(list_filter({kept}, lambda x, i: list_position({kept}, x) = i)[1:3], '+')"


@register("summary_signals", f"{W}, l AS (SELECT id, lower(document) AS low FROM records) SELECT id, {_signals_sql(S.MOODS)} AS moods, {_signals_sql(S.FLAGS)} AS flags FROM l")
def summary_signals(spark, root):
    doc = F.col("document")
    return V.records(spark, root).select("id", F.array_join(S.signals(doc, S.MOODS), "+").alias("moods"), F.array_join(S.signals(doc, S.FLAGS), "+").alias("flags"))


_STOPPED = "(" + ", ".join(f"'{w}'" for w in S.STOP) + ")"


@register(
    "summary_topics",
    f"""{W}, w AS (SELECT id, unnest(regexp_extract_all(document, '[a-zA-Z][a-zA-Z_-]{{2,}}')) AS w, generate_subscripts(regexp_extract_all(document, '[a-zA-Z][a-zA-Z_-]{{2,}}'), 1) AS pos FROM records),
    g AS (SELECT id, lower(w) AS word, min(pos) AS pos, sum(1 + CASE WHEN regexp_matches(w, '^[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(w, '[_-]|^.+[A-Z]') THEN 2 ELSE 0 END) AS weight
      FROM w WHERE lower(w) NOT IN {_STOPPED} GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, pos) AS k FROM g)
    SELECT records.id, coalesce(string_agg(word, '_' ORDER BY k), '') AS topics FROM records LEFT JOIN r ON r.id = records.id AND k <= 3 GROUP BY 1""",
)
def summary_topics(spark, root):
    return V.records(spark, root).select("id", F.array_join(S.topics(F.col("document")), "_").alias("topics"))


@register("compact_summary")
def compact_summary(spark, root):
    found = V.records(spark, root).select("id", S.header(F.col("domain"), F.col("topic"), F.col("filed_at"), F.col("source_file")).alias("header"), S.compact(F.col("document")).alias("line"), "document")
    return found.select("id", "header", "line", S.token_estimate(F.col("document")).alias("tokens_before"), S.token_estimate(F.col("line")).alias("tokens_after"))


@register("token_estimate", f"{W} SELECT id, greatest(1, CAST(len(list_filter(regexp_split_to_array(document, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) * 13 // 10 AS INTEGER)) AS tokens FROM records")
def token_estimate(spark, root):
    return V.records(spark, root).select("id", S.token_estimate(F.col("document")).alias("tokens"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@register(
    "sanitize_queries",
    rf"""WITH said AS (
      SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN repeat('You are a careful assistant.' || chr(10), 10) || 'Query: ' || text ELSE text END AS query FROM conversations WHERE role = 'user'
    ), cut AS (
      SELECT *, {_STRIP.format("query")} AS raw, list_filter(list_transform(string_split({_STRIP.format("query")}, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS lines FROM said
    ), found AS (
      SELECT *, coalesce(raw, '') = '' AS empty, CASE WHEN length(raw) <= 200 THEN raw END AS whole,
        {_STRIP.format(r"regexp_extract(raw, '(?is)\b(?:search\s+query|user\s+query|actual\s+query|query|question|task)\b\s*:\s*(\S.*)', 1)")} AS labelled,
        list_filter(lines, lambda x: regexp_matches(x, '[?？]\s*["'']?\s*$'))[-1] AS asked, right(list_filter(lines, lambda x: length(x) >= 10)[-1], 500) AS line FROM cut
    ), steps AS (
      SELECT *, CASE WHEN length(labelled) >= 10 THEN right(labelled, 500) END AS label, CASE WHEN length(asked) >= 10 THEN right(asked, 500) END AS question FROM found
    ), clean AS (
      SELECT *, CASE WHEN empty THEN coalesce(query, '') ELSE coalesce(whole, label, question, line, {_STRIP.format("right(raw, 500)")}) END AS clean_query FROM steps
    )
    SELECT conv_id, turn, clean_query, CASE WHEN empty OR whole IS NOT NULL THEN 'passthrough' WHEN label IS NOT NULL THEN 'labeled_tail' WHEN question IS NOT NULL THEN 'question_extraction'
      WHEN line IS NOT NULL THEN 'tail_sentence' ELSE 'tail_truncation' END AS method,
      CAST(CASE WHEN empty THEN coalesce(length(query), 0) ELSE length(raw) END AS INTEGER) AS original_length, CAST(length(clean_query) AS INTEGER) AS clean_length FROM clean""",
)
def sanitize_queries(spark, root):
    """Users' turns with a prompt's text before them."""
    asked = table(spark, root, "conversations").where("role = 'user'")
    prompted = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("You are a careful assistant.\n" * 10 + "Query: "), "text")).otherwise(F.col("text"))
    return asked.select("conv_id", "turn", sanitize(prompted).alias("q")).select("conv_id", "turn", "q.*")


@register("chunk_text")
def chunk_text(spark, root):
    return K.chunks(V.records(spark, root))


@register("exchange_slices")
def exchange_slices(spark, root):
    """Sessions as transcripts, cut into exchanges."""
    quoted = F.when(F.col("role") == "user", F.concat(F.lit("> "), "text")).otherwise(F.col("text"))
    lines = table(spark, root, "conversations").select("conv_id", F.struct("turn", quoted.alias("line")).alias("t"))
    texts = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "\n").alias("text"))
    return texts.select("conv_id", F.posexplode_outer(K.exchange_units(F.col("text"))).alias("chunk_index", "content")).where("content IS NOT NULL")
