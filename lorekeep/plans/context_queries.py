"""Halls of sessions and questions, tickets of trackers, and whether names are people's."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.functions import halls as H
from lorekeep.functions import people as P
from lorekeep.functions import tickets as T
from lorekeep.plans.registry import register

#: What is said beside the tables' texts, so that every case occurs.
_SAID = ("", " I prefer tea.", " I suggest: first, rest.", " My birthday was fine.", " A degree and a job.", " You told me so.", " When did it end?", " The city?")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list_sql(texts) -> str:
    return "[" + ", ".join(map(_quoted, texts)) + "]"


def _hits_sql(column: str, signals) -> str:
    return f"len(list_filter({_list_sql(signals)}, lambda s: contains({column}, s)))"


_TURNS = f"turns AS (SELECT conv_id, turn, role, text || ({_list_sql(_SAID)})[CAST(conv_id % {len(_SAID)} AS INTEGER) + 1] AS text FROM conversations)"


def _turns(spark, root):
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("conv_id") % len(_SAID) + 1).cast("int"))
    return table(spark, root, "conversations").select("conv_id", "turn", "role", F.concat("text", said).alias("text"))


@register(
    "session_halls",
    f"""WITH {_TURNS}, s AS (SELECT conv_id, lower(coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'user'), '')) AS u,
      lower(coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS a FROM turns GROUP BY 1)
    SELECT conv_id, CASE WHEN {_hits_sql("u", H.SAYS_PREFERENCE)} > 0 THEN '{H.PREFERENCES}' WHEN {_hits_sql("a", H.SAYS_ADVICE)} > 1 THEN '{H.ADVICE}'
      WHEN {_hits_sql("u || a", H.SAYS_EVENT)} > 0 THEN '{H.EVENTS}' WHEN {_hits_sql("u || a", H.SAYS_FACT)} > 1 THEN '{H.FACTS}' ELSE '{H.GENERAL}' END AS hall FROM s""",
)
def session_halls(spark, root):
    return H.sessions(_turns(spark, root))


@register(
    "question_halls",
    f"""WITH {_TURNS}, q AS (SELECT conv_id, turn, lower(text) AS q FROM turns WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN {_hits_sql("q", H.ASKS_ADVICE)} > 0 THEN '{H.ADVICE},{H.GENERAL}' WHEN {_hits_sql("q", H.ASKS_PREFERENCE)} > 0 THEN '{H.PREFERENCES},{H.GENERAL}'
      WHEN {_hits_sql("q", H.ASKS_EVENT)} > 0 THEN '{H.EVENTS},{H.FACTS},{H.GENERAL}' WHEN {_hits_sql("q", H.ASKS_FACT)} > 0 THEN '{H.FACTS},{H.GENERAL}' ELSE '{H.GENERAL}' END AS halls FROM q""",
)
def question_halls(spark, root):
    asked = _turns(spark, root).where("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(H.question_halls(F.col("text")), ",").alias("halls"))


_TICKETS = """tickets AS (SELECT doc_id, source AS title, 'Map: #' || (doc_id % 40) || chr(10) || text || chr(10) || 'Blocked by:  #3 ' || chr(10) AS body,
  CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Done in ' || lang || ' ' END AS resolution, 'https://forge.example/acme/' || lang || '-Notes/issues/' || doc_id AS url, 'acme/' || lang || '-Notes' AS repo FROM documents)"""
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register(
    "ticket_records",
    rf"""WITH {_TICKETS}, p AS (SELECT *, trim(regexp_replace(body, '(?m)^(?:Map|Blocked by):\s*#\d+\s*$\n?', '', 'g'), {_BLANKS}) AS kept, trim(coalesce(resolution, ''), {_BLANKS}) AS done,
      replace(lower(split_part(repo, '/', 2)), '-', '_') AS domain FROM tickets)
    SELECT 'drawer_' || domain || '_decisions_' || left(sha256(url), 24) AS id, domain, CAST(regexp_extract(body, '(?m)^Map:\s*#(\d+)\s*$', 1) AS BIGINT) AS map_ref,
      sha256('# ' || title || CASE WHEN kept <> '' THEN chr(10) || chr(10) || kept ELSE '' END || CASE WHEN done <> '' THEN chr(10) || chr(10) || done ELSE '' END) AS content_hash FROM p""",
)
def ticket_records(spark, root):
    d = table(spark, root, "documents").selectExpr(
        "source AS title",
        r"concat('Map: #', doc_id % 40, '\n', text, '\nBlocked by:  #3 \n') AS body",
        r"CASE WHEN doc_id % 3 = 0 THEN concat('\nDone in ', lang, ' ') END AS resolution",
        "concat('https://forge.example/acme/', lang, '-Notes/issues/', doc_id) AS url",
        "concat('acme/', lang, '-Notes') AS repo",
    )
    domain = T.repo_domain(F.col("repo"))
    text = T.ticket_text(F.col("title"), F.col("body"), F.col("resolution"))
    return d.select(T.ticket_id(domain, F.col("url")).alias("id"), domain.alias("domain"), T.map_ref(F.col("body")).alias("map_ref"), F.sha2(text, 256).alias("content_hash"))


@register(
    "remote_repos",
    """WITH u AS (SELECT p_partkey, replace(p_name, ' ', '-') AS name FROM part), f AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'gitea' WHEN 1 THEN 'github' WHEN 2 THEN 'github' END AS forge FROM u)
    SELECT p_partkey, forge, CASE WHEN forge IS NOT NULL THEN 'acme/' || name END AS repo, CASE p_partkey % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'gone' ELSE 'transient' END AS error FROM f""",
)
def remote_repos(spark, root):
    parts = table(spark, root, "part").selectExpr(
        "p_partkey",
        """concat(CASE p_partkey % 4 WHEN 0 THEN 'ssh://git@forge.example:2222/acme/' WHEN 1 THEN ' https://github.com/acme/' WHEN 2 THEN 'git@github.com:acme/' ELSE 'https://elsewhere.example/acme/' END,
        replace(p_name, ' ', '-'), CASE WHEN p_partkey % 5 < 3 THEN '.git' ELSE '' END) AS url""",
        "CASE p_partkey % 3 WHEN 0 THEN 'HTTP 403' WHEN 1 THEN 'Not Found' ELSE 'timeout' END AS said",
    )
    found = parts.withColumn("r", T.remote_repo(F.col("url"), ("forge.example:3000", ":80")))
    return found.select("p_partkey", "r.forge", "r.repo", T.forge_error(F.col("said")).alias("error"))


_NAME = "Rivka"
_AROUND = ("", "Rivka: hello\nthen she left", "> Rivka: yes\nhey Rivka, Rivka said so", "building Rivka and\nimport Rivka\nRivka.py", "Rivka v2 of the Rivka system\nRivka-core", "Rivka thinks\nand they agree\nRivka.js", "by Rivka")


def _count_sql(patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(text, '(?mi){p.replace('@', _NAME)}'))" for p in patterns) + ")"


@register(
    "name_kinds",
    f"""WITH t AS (SELECT conv_id, turn, text || chr(10) || replace(({_list_sql(a.replace(chr(10), '~') for a in _AROUND)})[CAST((conv_id + turn) % {len(_AROUND)} AS INTEGER) + 1], '~', chr(10)) AS text FROM conversations),
    l AS (SELECT *, string_split(lower(text), chr(10)) AS lines FROM t),
    c AS (SELECT conv_id, turn, {", ".join(f"{_count_sql(p)} AS {k}" for k, (p, _) in (P.PERSON | P.PROJECT).items())},
      len(list_filter(range(1, len(lines) + 1), lambda i: contains(lines[i], '{_NAME.lower()}') AND regexp_matches(array_to_string(lines[greatest(i - 2, 1):i + 2], ' '), '{P.PRONOUNS}'))) AS pronoun FROM l),
    s AS (SELECT *, 3 * dialogue + 2 * action + 4 * addressed + 2 * pronoun AS person, 2 * verbs + 3 * versioned + 3 * code AS project,
      CAST(dialogue > 0 AS INT) + CAST(action > 0 AS INT) + CAST(pronoun > 0 AS INT) + CAST(addressed > 0 AS INT) AS kinds FROM c),
    r AS (SELECT *, CASE WHEN person + project > 0 THEN person / CAST(person + project AS DOUBLE) END AS share FROM s)
    SELECT conv_id, turn, CAST(person AS BIGINT) AS person, CAST(project AS BIGINT) AS project,
      CASE WHEN share >= 0.7 AND kinds >= 2 AND person >= 5 THEN 'person' WHEN share <= 0.3 THEN 'project' ELSE 'uncertain' END AS kind,
      round(CASE WHEN share IS NULL THEN CAST(0.06 AS DOUBLE) WHEN share >= 0.7 AND kinds >= 2 AND person >= 5 THEN least(0.99, 0.5 + share * 0.5) WHEN share >= 0.7 THEN 0.4 WHEN share <= 0.3 THEN least(0.99, 0.5 + (1 - share) * 0.5) ELSE 0.5 END, 2) AS confidence FROM r""",
)
def name_kinds(spark, root):
    around = F.element_at(F.array(*map(F.lit, _AROUND)), ((F.col("conv_id") + F.col("turn")) % len(_AROUND) + 1).cast("int"))
    said = table(spark, root, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n"), around).alias("text"))
    counts = P.signals(F.col("text"), _NAME)
    counted = said.select("conv_id", "turn", *(c.alias(k) for k, c in counts.items()))
    by_kind = {k: F.col(k) for k in counts}
    kind, confidence = P.classified(F.lit(3), by_kind)
    score = lambda c: c.cast("long")
    return counted.select("conv_id", "turn", score(P.person_score(by_kind)).alias("person"), score(P.project_score(by_kind)).alias("project"), kind.alias("kind"), confidence.alias("confidence"))
