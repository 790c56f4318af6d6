"""Rejected files, phrases of time, and timing summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine import views as V
from lorekeep.engine.session import table
from lorekeep.functions import probes as P
from lorekeep.plans.registry import register


@register(
    "file_rejection",
    f"""WITH {V.RECORDS_SQL}, l AS (SELECT id, document, length(document) AS n, regexp_split_to_array(regexp_replace(document, '\\r?\\n\\z', ''), '\\r?\\n') AS lines FROM records),
    m AS (SELECT id, n, len(lines) AS lines, list_max(list_transform(lines, lambda x: length(x))) AS longest, list_sum(list_transform(lines, lambda x: length(x))) AS held, array_to_string(lines[1:3], chr(10)) AS head,
      CASE WHEN n > 2000 THEN left(document, 1000) || right(document, 1000) ELSE document END AS ends,
      n - length(regexp_replace(document, '[\\t-\\r \\x{{85}}\\p{{Z}}]', '', 'g')) AS blanks, n - length(regexp_replace(document, '[\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum FROM l)
    SELECT id, CASE WHEN longest > 500 THEN 'long_line' WHEN regexp_matches(head, '{P.GENERATED_HEADER}') THEN 'generated_header' WHEN regexp_matches(head, '{P.LICENSE_BANNER}') THEN 'license_banner'
      WHEN regexp_matches(ends, '{P.BUNDLED}') THEN 'bundled' WHEN n > 0 AND blanks < 0.05 * n THEN 'few_blanks' WHEN held > 200 * lines THEN 'long_average' WHEN n - blanks - alnum > 1.5 * alnum THEN 'many_symbols' END AS reason FROM m""",
)
def file_rejection(spark, root):
    return V.records(spark, root).select("id", P.file_rejection(F.col("document"), F.col("source_file")).alias("reason"))


_ASKED = "'what did I order ' || CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || ' days ago' WHEN 1 THEN CAST(p_size AS VARCHAR) || ' weeks ago' WHEN 2 THEN 'last month' ELSE 'then' END"


@register(
    "relative_time",
    f"""WITH q AS (SELECT p_partkey, {_ASKED} AS q FROM part), m AS (SELECT *, TRY_CAST(regexp_extract(q, '(\\d+)', 1) AS INTEGER) AS n FROM q)
    SELECT p_partkey, CASE WHEN q LIKE '%days ago' THEN n WHEN q LIKE '%weeks ago' THEN n * 7 WHEN q LIKE '%last month' THEN 30 END AS days,
      CASE WHEN q LIKE '%days ago' THEN 2 WHEN q LIKE '%weeks ago' THEN 5 WHEN q LIKE '%last month' THEN 7 END AS tolerance FROM m""",
)
def relative_time(spark, root):
    asked = F.expr(_ASKED.replace("VARCHAR", "STRING"))
    return table(spark, root, "part").select("p_partkey", P.relative_time(asked).alias("t")).select("p_partkey", "t.days", "t.tolerance")


@register(
    "timing_summary",
    """SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS stdev FROM events GROUP BY 1""",
)
def timing_summary(spark, root):
    found = table(spark, root, "events").groupBy("event_type").agg(*P.timings("value"))
    return found.select("event_type", "n", "min", "max", *(F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")))
