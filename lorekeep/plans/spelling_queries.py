"""Spelling of what users say, by the words of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.operators import spelling as S
from lorekeep.plans.registry import register

# Every token of every user's turn against every word of the dictionary; DuckDB's regular expressions know no look-around, so words
# are cut out by what stands between them. Its distance counts bytes, so letters of the tables beyond ASCII become one byte each first.
_LETTERS = "äöüÄÖÜßéèêÉÈÊçÇñÑóÓíÍáÁúÚ"
_FLAT = f"translate(%s, '{_LETTERS}', {' || '.join(f'chr({k})' for k in [*range(1, 9), *range(14, 32)][: len(_LETTERS)])})"
_FOUND = r"""words AS (
  SELECT word, count(*) AS times FROM (SELECT unnest(regexp_split_to_array(text, '[^\p{L}\p{N}_]+')) AS word FROM documents)
  WHERE regexp_full_match(word, '\p{Ll}{4,}') GROUP BY word HAVING count(*) >= 3
), said AS (
  SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'
), tokens AS (
  SELECT DISTINCT rtrim(unnest(regexp_split_to_array(text, '\s+')), '.,!?;:''")') AS word FROM said
), unknown AS (
  SELECT word, CASE WHEN length(word) <= 7 THEN 2 ELSE 3 END AS cap FROM tokens
  WHERE length(word) >= 4 AND NOT regexp_matches(word, '^\p{Lu}') AND NOT regexp_matches(word, '\p{Nd}|[A-Z][a-z]+[A-Z]|[-_]|[`*_#{}\[\]\\]')
    AND NOT regexp_matches(word, '^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$') AND NOT regexp_matches(word, '(?i)https?://|www\.|/Users/|~/|\.[a-z]{2,4}$')
    AND lower(word) NOT IN (SELECT word FROM words)
), near AS (
  SELECT u.word, w.word AS correct, w.times, levenshtein(""" + _FLAT % "u.word" + ", " + _FLAT % "w.word" + r""") AS edits, cap
  FROM unknown u JOIN words w ON abs(length(u.word) - length(w.word)) <= cap
), best AS (
  SELECT word, correct FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY edits, times DESC, correct) AS n FROM near WHERE edits <= cap) WHERE n = 1
)"""


def _said(spark, root):
    turns = table(spark, root, "conversations").where("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("document"))


@register("spelling_corrections", f"WITH {_FOUND} SELECT word, correct FROM best")
def spelling_corrections(spark, root):
    tokens = _said(spark, root).select(F.explode(F.transform(F.split("document", r"\s+"), S.bare)).alias("word"))
    return S.corrections(tokens, S.dictionary(table(spark, root, "documents"), text_col="text"))


@register(
    "spelling_corrected",
    rf"""WITH {_FOUND}, pieces AS (
      SELECT id, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS piece FROM (SELECT id, regexp_extract_all(text, '\s+|\S+') AS p FROM said)
    )
    SELECT id, sha256(string_agg(coalesce(correct || substr(piece, length(rtrim(piece, '.,!?;:''")')) + 1), piece), '' ORDER BY k)) AS document_sha256
    FROM pieces LEFT JOIN best ON best.word = rtrim(piece, '.,!?;:''")') GROUP BY id""",
)
def spelling_corrected(spark, root):
    out = S.corrected(_said(spark, root), S.dictionary(table(spark, root, "documents"), text_col="text"))
    return out.select("id", F.sha2("document", 256).alias("document_sha256"))
