"""Documents as structured notes: one file for each source and language, a note for each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.functions import notes as N
from lorekeep.operators import notes as O
from lorekeep.plans.registry import register

KNOWN, SKIP = {"The": "DEF", "Ein": "IND"}, ("ingsh",)
TONES = ("joyful", "raw_grief", "self_doubt", "calm_focus")


def notes(spark, root):
    docs = table(spark, root, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.col("doc_id")
    tone = lambda k: F.element_at(F.array(*map(F.lit, TONES)), k.cast("int"))
    return docs.select(
        F.concat("source", F.lit("-"), "lang", F.lit(" notes.txt")).alias("file"),
        n.alias("position"),
        F.concat(F.lit("note-"), n).alias("note_id"),
        F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), 0), 1, 3).alias("people"),
        F.slice(F.regexp_extract_all("text", F.lit("[a-z_]{6,}"), 0), 1, 2).alias("topics"),
        F.when(n % 3 == 0, F.col("text")).otherwise(F.concat(F.lit('"'), F.substring("text", 10, 30), F.lit('" '), "text", F.lit(" Ann said: "), F.substring("text", 50, 40), F.lit("!"))).alias("content"),
        F.concat(F.lit("entry - "), F.substring("text", 1, 60)).alias("title"),
        F.lit(None).cast("string").alias("origin_label"),
        F.element_at(F.array(*map(F.lit, ("a foundational pillar", "of the Genesis", "pivot and core", "none"))), (n % 4 + 1).cast("int")).alias("notes"),
        (F.length("text") % 101 / F.lit(100.0)).alias("weight"),
        F.array(tone(n % 4 + 1), tone(n * 3 % 4 + 1), tone(n % 2 + 1)).alias("tones"),
        (n % 10 == 0).alias("origin_moment"),
        F.when(n % 7 == 0, "maximum, private").when(n % 7 == 1, "low").alias("sensitivity"),
        F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("string").alias("date"),
    )


def links(spark, root):
    n = F.col("doc_id")
    label = F.when(n % 2 == 0, F.concat(F.lit("next: "), "lang")).otherwise(F.concat(F.lit("then "), F.substring(F.coalesce("text", F.lit("")), 1, 60)))
    file = F.concat("source", F.lit("-"), "lang", F.lit(" notes.txt"))
    return table(spark, root, "documents").select(file.alias("file"), n.alias("position"), F.concat(F.lit("note-"), n).alias("from_id"), F.concat(F.lit("note-"), n + 1).alias("to_id"), label.alias("label"))


_FELT = "[" + ", ".join(f"'{w}'" for w in N.FELT) + "]"
NOTES_SQL = rf"""t AS (SELECT doc_id AS n, coalesce(text, '') AS text, source, lang FROM documents), raw AS (
  SELECT source || '-' || lang || ' notes.txt' AS file, source, lang, n, text,
    regexp_extract_all(text, '[A-Z][a-z]{{3,}}')[1:3] AS people, array_to_string(regexp_extract_all(text, '[a-z_]{{6,}}')[1:2], '_') AS topics,
    CASE WHEN n % 3 = 0 THEN text ELSE '"' || substr(text, 10, 30) || '" ' || text || ' Ann said: ' || substr(text, 50, 40) || '!' END
      || '  ' || ['a foundational pillar', 'of the Genesis', 'pivot and core', 'none'][n % 4 + 1] AS said,
    substr(text, 1, 60) AS title, CAST(length(text) % 101 AS DOUBLE) / 100 AS weight,
    [['joy', 'grief', 'doubt', 'calm'][n % 4 + 1], ['joy', 'grief', 'doubt', 'calm'][n * 3 % 4 + 1], ['joy', 'grief'][n % 2 + 1]] AS tones,
    array_to_string(list_filter([CASE WHEN n % 10 = 0 THEN 'ORIGIN' END, CASE WHEN n % 7 = 0 THEN 'SENSITIVE' END, CASE WHEN n % 4 IN (0, 2) THEN 'CORE' END,
      CASE WHEN n % 4 = 1 THEN 'GENESIS' END, CASE WHEN n % 4 = 2 THEN 'PIVOT' END], lambda x: x IS NOT NULL), '+') AS flags,
    strftime(DATE '2024-01-01' + CAST(n AS INTEGER), '%Y-%m-%d') AS date FROM t
), quoted AS (
  SELECT *, list_filter(list_transform(list_concat(list_concat(regexp_extract_all(said, '"([^"]{{8,55}})"', 1), regexp_extract_all(said, '(?:^|[\s(])''([^'']{{8,55}})''(?:[\s.,;:!?)]|$)', 1)),
    regexp_extract_all(said, '(?i)(?:says?|said|articulates?|reveals?|admits?|confesses?|asks?):\s*["'']?([^.!?]{{10,55}})[.!?]', 1)),
    lambda q: regexp_replace(q, '^\s+|\s+$', '', 'g')), lambda q: length(q) >= 8) AS quotes FROM raw
), coded AS (
  SELECT *, coalesce(list_max(list_transform(quotes, lambda q, k: {{'w': 2 * list_sum(list_transform({_FELT}, lambda f: CAST(contains(lower(q), f) AS INTEGER)))
      + CASE WHEN regexp_matches(q, '^\p{{Lu}}') THEN 2 ELSE 0 END + CASE WHEN length(q) > 20 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(q, '^(The|This|She) ') THEN 2 ELSE 0 END,
      'k': -k, 'q': q}})).q, left(title, 45)) AS quote0,
    list_sort(list_distinct(list_filter(list_transform(people, lambda p: CASE WHEN contains(lower(p), 'ingsh') THEN NULL WHEN contains(lower(p), 'the') THEN 'DEF'
      WHEN contains(lower(p), 'ein') THEN 'IND' ELSE upper(left(p, 3)) END), lambda c: c IS NOT NULL))) AS codes,
    array_to_string(list_filter(tones, lambda x, i: list_position(tones, x) = i), '+') AS tone FROM quoted
), note AS (
  SELECT *, regexp_replace(quote0, '[\r\n]', ' ', 'g') AS quote, CASE WHEN len(codes) = 0 THEN '???' ELSE array_to_string(codes, '+') END AS names FROM coded
)"""

_NOTE_LINE = """n || ':' || names || '|' || CASE WHEN topics = '' THEN 'misc' ELSE topics END || CASE WHEN quote = '' THEN '' ELSE '|"' || quote || '"' END
  || '|' || CAST(weight AS VARCHAR) || '|' || tone || CASE WHEN flags = '' THEN '' ELSE '|' || flags END"""
_LABEL = "CASE WHEN contains(label, ':') THEN split_part(label, ':', 1) ELSE left(label, {most}) END"
_LINKS = f"""links AS (SELECT file, n, CASE WHEN n % 2 = 0 THEN 'next: ' || lang ELSE 'then ' || substr(text, 1, 60) END AS label FROM raw)"""
_LINES = rf"""WITH {NOTES_SQL}, {_LINKS}, firsts AS (
  SELECT file, any_value(source) AS source, any_value(lang) AS lang, min_by(date, n) AS date, (list_sort(list_distinct(flatten(list(codes)))))[1:3] AS codes FROM note GROUP BY file
), lines AS (
  SELECT file, 0 AS part, CAST(0 AS BIGINT) AS position, source || '|' || CASE WHEN len(codes) = 0 THEN '???' ELSE array_to_string(codes, '+') END || '|' || date || '|' || lang || ' notes' AS line FROM firsts
  UNION ALL SELECT file, 1, 0, 'ARC:from ' || lang FROM firsts
  UNION ALL SELECT file, 2, n, {_NOTE_LINE} FROM note
  UNION ALL SELECT file, 3, n, 'T:' || n || '<->' || (n + 1) || '|' || regexp_replace({_LABEL.format(most=30)}, '[|\r\n]', ' ', 'g') FROM links
)"""


def _lines(spark, root):
    found = notes(spark, root)
    arcs = found.select("file").distinct().select("file", F.concat(F.lit("from "), F.regexp_extract("file", "-(.*) notes", 1)).alias("arc"))
    return O.lines(found, links(spark, root), arcs, KNOWN, SKIP)


@register("note_lines", f"{_LINES} SELECT * FROM lines")
def note_lines(spark, root):
    return _lines(spark, root)


@register("note_archive", f"{_LINES} SELECT * FROM lines UNION ALL SELECT DISTINCT file, 4, 0, '---' FROM lines")
def note_archive(spark, root):
    return O.archive(_lines(spark, root))


@register(
    "note_fields",
    f"""WITH {NOTES_SQL} SELECT file, n AS position, CAST(n AS VARCHAR) AS note_id, names, CASE WHEN topics = '' THEN 'misc' ELSE topics END AS topic, quote, weight, tone AS tones, flags FROM note""",
)
def note_fields(spark, root):
    """The fields of notes, read back from their lines."""
    kept = O.decode(_lines(spark, root).where(F.col("part") == O.NOTE))
    joined = (F.array_join(c, "+").alias(c) for c in ("names", "tones", "flags"))
    return kept.select("file", "position", "note_id", "topic", "quote", "weight", *joined)


@register(
    "note_digest",
    rf"""WITH {NOTES_SQL}, {_LINKS}, days AS (SELECT file, min_by(date, n) AS day FROM note GROUP BY file), kept AS (
      SELECT * FROM note JOIN days USING (file) WHERE weight >= 0.85 OR n % 10 = 0 OR n % 4 <> 3
    ), first AS (SELECT * FROM links ORDER BY file, n LIMIT 8)
    SELECT 1 AS part, day AS date, '=MOMENTS[' || day || ']=' AS line FROM (SELECT DISTINCT day FROM kept)
    UNION ALL SELECT 1, day, names || CASE WHEN title = '' THEN '' ELSE '|' || regexp_replace(left(title, 30), '[|\r\n]', ' ', 'g') END
      || CASE WHEN quote <> '' AND quote <> left(title, 30) AND quote <> 'entry - ' || title THEN '|"' || quote || '"' ELSE '' END
      || CASE WHEN n % 7 = 1 THEN '|SENSITIVE' ELSE '' END || '|' || CAST(weight AS VARCHAR) || CASE WHEN flags = '' THEN '' ELSE '|' || flags END FROM kept
    UNION ALL SELECT 2, '', '=TUNNELS=' UNION ALL SELECT 2, '', regexp_replace({_LABEL.format(most=40)}, '[|\r\n]', ' ', 'g') FROM first""",
)
def note_digest(spark, root):
    return O.digest(notes(spark, root), links(spark, root), known=KNOWN, skip=SKIP).select("part", "date", "line")
