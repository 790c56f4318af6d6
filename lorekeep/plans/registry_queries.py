"""A registry of names made from the documents, and which of them the conversations name."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.engine.shared import store
from lorekeep.operators import known_names as K
from lorekeep.plans.registry import register

#: A capitalised word is a person here if the documents hold it so often; one that they hold in lower case too is ambiguous.
LEAST = 20


#: A letter that no text holds, for the key: patterns are then the same for all keys, and compiled once.
SIGN = "ꙮ"


def _plain(pattern: str) -> str:
    """A pattern whose ends of words are what is no letter, digit or underscore: DuckDB's \\b knows ASCII only."""
    out = re.sub(r"^\\b", r"(?:^|[^\\p{L}\\p{N}_])", pattern)
    out = re.sub(r"\\b$", r"(?:$|[^\\p{L}\\p{N}_])", out).replace("@", SIGN)
    return "'" + out.replace("'", "''") + "'"


def _votes(patterns: tuple[str, ...]) -> str:
    # A key that is part of a pattern's own words is the sign there too, as it is in the text.
    one = lambda p: f"CAST(CASE WHEN contains({p}, key) THEN regexp_matches(marked, replace({p}, key, '{SIGN}')) ELSE regexp_matches(marked, {p}) END AS INTEGER)"
    return " + ".join(one(_plain(p)) for p in patterns)


_VOTED = rf"""w AS (
  SELECT unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+')) AS word FROM documents
), caps AS (
  SELECT word AS name FROM w WHERE regexp_full_match(word, '[A-Z][a-z]{{2,15}}') GROUP BY word HAVING count(*) >= {LEAST}
), alias AS (
  SELECT left(name, 4) AS a, name FROM caps WHERE length(name) > 6
), entries AS (
  SELECT name, lower(name) AS key FROM caps UNION SELECT name, lower(a) FROM alias
  UNION SELECT a, lower(a) FROM alias WHERE a NOT IN (SELECT name FROM caps) UNION SELECT a, lower(name) FROM alias WHERE a NOT IN (SELECT name FROM caps)
), lows AS (
  SELECT DISTINCT word FROM w WHERE regexp_full_match(word, '[a-z]+')
), keys AS (
  SELECT key, bool_or(lower(name) = key AND key IN (SELECT word FROM lows)) AS ambiguous FROM entries GROUP BY key
), said AS (
  SELECT conv_id * 1000 + turn AS id, lower(text) AS low, regexp_split_to_array(lower(text), '\s+') AS t FROM conversations
), led AS (
  -- what stands before one of the words of the last pattern, which needs no beginning of a word in front of the key
  SELECT id, low, list_transform(list_filter(range(1, len(t)), lambda i: regexp_matches(t[i + 1], '^(?:of|in|at|for|to)(?:$|[^\p{{L}}\p{{N}}_])')), lambda i: t[i]) AS before FROM said
), here AS (
  SELECT id, low, before, key, ambiguous, replace(low, key, '{SIGN}') AS marked
  FROM (SELECT DISTINCT id, unnest(regexp_split_to_array(low, '[^\p{{L}}\p{{N}}_]+')) AS key FROM said) JOIN keys USING (key) JOIN led USING (id)
), voted AS (
  SELECT id, key, ambiguous, CASE WHEN ambiguous THEN {_votes(K.FOR)} ELSE 0 END AS persons,
         CASE WHEN ambiguous THEN {_votes(K.AGAINST[:-1])} + CAST(len(list_filter(before, lambda x: ends_with(x, key))) > 0 AS INTEGER) ELSE 0 END AS concepts FROM here
)"""


def _said(spark, root):
    return table(spark, root, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("document"))


def _registry(spark, root):
    words = table(spark, root, "documents").select(F.explode(F.split("text", r"[^\p{L}\p{N}_]+")).alias("word"))
    words = store(words.where(F.col("word").rlike(r"\A([A-Z][a-z]{2,15}|[a-z]+)\z")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "registry-words")
    caps = words.where(F.col("word").rlike(r"\A[A-Z]") & (F.col("n") >= LEAST)).select(F.col("word").alias("name"))
    people = caps.select("name", F.lit("").alias("relationship"), F.lit("work").alias("context"))
    aliases = caps.where(F.length("name") > 6).select(F.left("name", F.lit(4)).alias("alias"), "name")
    made = K.seeded(people, table(spark, root, "nation").select(F.col("n_name").alias("name")), aliases)
    lows = words.where(F.col("word").rlike(r"\A[a-z]+\z")).select(F.col("word").alias("low")).withColumn("seen", F.lit(True))
    flag = (F.col("kind") == "person") & F.coalesce("seen", F.lit(False))
    return store(made.withColumn("low", F.lower("name")).join(lows, "low", "left").withColumn("ambiguous", flag).select(*made.columns), "registry")


@register("names_mentioned", f"WITH {_VOTED} SELECT id, key, persons, concepts FROM voted")
def names_mentioned(spark, root):
    return K.mentions(_said(spark, root), _registry(spark, root).where("kind = 'person'"))


@register("people_mentioned", f"WITH {_VOTED} SELECT DISTINCT id, name FROM voted JOIN entries USING (key) WHERE NOT ambiguous OR persons > concepts")
def people_mentioned(spark, root):
    return K.people_in(_said(spark, root), _registry(spark, root))


@register(
    "names_unknown",
    rf"""WITH {_VOTED}, caught AS (
      SELECT DISTINCT conv_id * 1000 + turn AS id, unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+')) AS word FROM conversations
    )
    SELECT id, word FROM caught WHERE regexp_full_match(word, '[A-Z][a-z]{{2,15}}') AND lower(word) NOT IN (SELECT key FROM keys)
      AND lower(word) NOT IN (SELECT lower(n_name) FROM nation) AND lower(word) NOT IN ({", ".join(f"'{w}'" for w in K.COMMON)})""",
)
def names_unknown(spark, root):
    return K.unknown_names(_said(spark, root), _registry(spark, root))
