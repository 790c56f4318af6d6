"""Names, rooms of files, speakers, and times as they are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.engine.session import table
from lorekeep.functions import names as N
from lorekeep.plans.registry import register

W = f"WITH {V.RECORDS_SQL}"
ROOMS = {"frontend": ["front", "ui"], "billing": ["invoice", "the"], "testing": ["qa", "que"]}
HINTS = {"src": "code", "src1": "first", "notes/src1": "noted"}
FOLDERS = {"frontend": "frontend", "views": "frontend", "backend": "backend", "api": "backend", "docs": "documentation", "notes": "documentation", "tests": "testing"}

_PATH = "CASE chunk_index % 4 WHEN 0 THEN 'proj/Front-end/' || topic || '.txt' WHEN 1 THEN 'src/billing_notes.md' WHEN 2 THEN 'notes/' || topic || '/a.api.txt' ELSE 'z_tests.txt' END"


def _filed(spark, root):
    at = F.col("chunk_index") % 4
    path = F.when(at == 0, F.concat(F.lit("proj/Front-end/"), "topic", F.lit(".txt"))).when(at == 1, "src/billing_notes.md").when(at == 2, F.concat(F.lit("notes/"), "topic", F.lit("/a.api.txt"))).otherwise("z_tests.txt")
    return V.records(spark, root).select("id", "document", path.alias("path"))


def _times(word: str) -> str:
    return f"(length(low) - length(replace(low, '{word}', ''))) // {len(word)}"


@register(
    "room_of_file",
    f"""{W}, f AS (SELECT id, chunk_index % 4 AS kind, lower(document) AS low FROM records),
    c AS (SELECT *, {_times("front")} + {_times("ui")} + {_times("frontend")} AS a, {_times("invoice")} + {_times("the")} + {_times("billing")} AS b, {_times("qa")} + {_times("que")} + {_times("testing")} AS t FROM f)
    SELECT id, CASE WHEN kind = 0 THEN 'frontend' WHEN kind = 1 THEN 'billing' WHEN greatest(a, b, t) = 0 THEN 'general' WHEN a >= b AND a >= t THEN 'frontend' WHEN b >= t THEN 'billing' ELSE 'testing' END AS room FROM c""",
)
def room_of_file(spark, root):
    return _filed(spark, root).select("id", N.room_of(F.col("path"), F.col("document"), ROOMS, head=None).alias("room"))


@register(
    "rooms_proposed",
    f"""{W}, p AS (SELECT lower(regexp_extract({_PATH}, '([^/]*)$', 1)) AS name FROM records),
    h AS (SELECT 'documentation' AS room FROM p WHERE contains(name, 'notes') UNION ALL SELECT 'backend' FROM p WHERE contains(name, 'api') UNION ALL SELECT 'testing' FROM p WHERE contains(name, 'tests')
      UNION ALL SELECT 'documentation' FROM p WHERE contains(name, 'docs') UNION ALL SELECT 'frontend' FROM p WHERE contains(name, 'views') OR contains(name, 'frontend') UNION ALL SELECT 'backend' FROM p WHERE contains(name, 'backend'))
    SELECT room, count(*) AS n FROM h GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 6""",
)
def rooms_proposed(spark, root):
    return N.proposed_rooms(_filed(spark, root), FOLDERS)


@register("domain_hints", f"{W} SELECT id, CASE WHEN contains(p, 'notes/src1') THEN 'noted' WHEN contains(p, 'src1') THEN 'first' WHEN contains(p, 'src') THEN 'code' END AS hint FROM (SELECT id, lower({_PATH}) AS p FROM records)")
def domain_hints(spark, root):
    return _filed(spark, root).select("id", N.hinted(F.col("path"), HINTS).alias("hint"))


_NAME = "CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN repeat('x', 129) WHEN 2 THEN concat('a/', p_name) WHEN 3 THEN p_brand WHEN 4 THEN concat('a', '..', 'b') WHEN 5 THEN NULL ELSE p_name END"


@register(
    "name_errors",
    f"""WITH n AS (SELECT p_partkey, trim(coalesce({_NAME}, ''), ' ') AS s FROM part)
    SELECT p_partkey, CASE WHEN s = '' THEN 'empty' WHEN length(s) > 128 THEN 'too long' WHEN contains(s, '..') OR contains(s, '/') THEN 'path' WHEN NOT regexp_full_match(s, '[a-zA-Z0-9_][a-zA-Z0-9_ .''\\-]*') THEN 'characters' END AS error FROM n""",
)
def name_errors(spark, root):
    return table(spark, root, "part").select("p_partkey", N.name_error(F.expr(_NAME)).alias("error"))


# Whole turns with lines of speakers around them, and with names that speakers give themselves.
_SAID = "concat('Anna', conv_id % 5, ': ', text, chr(10), 'user: I am Bob', turn, ' indeed', chr(10), 'Cleo-2: hi', chr(10), 'Anna', turn % 5, ': and call me Dora.')"


@register(
    "personas",
    rf"""WITH s AS (
      SELECT conv_id, turn, {_SAID} AS said FROM conversations
    ), f AS (
      SELECT conv_id, turn, list_concat(regexp_extract_all(said, '(?m)^([A-Z][A-Za-z0-9_-]{{1,30}}):', 1),
                                        regexp_extract_all(said, '(?i)\b(?:i am|i''m|call me)\s+([A-Z][A-Za-z0-9_-]{{1,30}})\b', 1)) AS n FROM s
    )
    SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(n) + 1), lambda i: list_position(n, n[i]) = i
             AND lower(n[i]) NOT IN ('user', 'assistant', 'system', 'human')), lambda i: n[i]), ',') AS names FROM f""",
)
def personas(spark, root):
    return table(spark, root, "conversations").select("conv_id", "turn", F.array_join(N.personas(F.expr(_SAID)), ",").alias("names"))


_RAW = "CASE event_id % 4 WHEN 0 THEN concat(t, 'Z') WHEN 1 THEN concat(t, '+02:00') WHEN 2 THEN t ELSE '' END"


@register(
    "iso_times",
    f"""WITH e AS (SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN us WHEN 1 THEN us - 7200000000 WHEN 2 THEN us ELSE -9223372036854775807 END AS us FROM e""",
)
def iso_times(spark, root):
    second = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    rows = table(spark, root, "events").select("event_id", F.date_format(F.to_utc_timestamp(second, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    return rows.select("event_id", N.utc_micros(F.expr(_RAW)).alias("us"))
