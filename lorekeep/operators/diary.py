"""Diaries of agents, and the digest that a session begins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.catalog import named

# The digest's limits and what marks a cut one.
MOST_LINES, MOST_BYTES, CUT = 200, 25 * 1024, "\n\n[digest truncated]"


def domain_of(agent: Column) -> Column:
    return F.concat(F.lit("wing_"), F.replace(F.lower(agent), F.lit(" "), F.lit("_")))


def write(entries: DataFrame) -> DataFrame:
    """(agent, topic, entry, filed_at) as records; the id has the agent, the time and a hash of the entry's first 50
    characters, so that the same entry of one second is one record."""
    stamp = F.replace(F.regexp_replace(F.substring("filed_at", 1, 19), "[-:]", ""), F.lit("T"), F.lit("_"))
    entry_id = F.concat(F.lit("diary_"), domain_of(F.col("agent")), F.lit("_"), stamp, F.lit("_"), F.substring(F.sha2(F.substring("entry", 1, 50), 256), 1, 12))
    return entries.select(
        entry_id.alias("id"),
        F.col("entry").alias("document"),
        domain_of(F.col("agent")).alias("domain"),
        F.lit("diary").alias("topic"),
        F.col("topic").alias("subject"),
        "agent",
        "filed_at",
        F.substring("filed_at", 1, 10).alias("date"),
    )


def read(records: DataFrame, agent: str, n: int) -> DataFrame:
    """An agent's newest entries, the last first; missing times come last and ties go by id."""
    own = records.where((F.col("domain") == domain_of(F.lit(agent))) & (F.col("topic") == "diary"))
    return own.orderBy(F.coalesce("filed_at", F.lit("")).desc(), F.desc("id")).limit(n).select("id", "date", "filed_at", "subject", "document")


def newest(records: DataFrame) -> DataFrame:
    """One row: date and subject of the last entry of all diaries; ties go to the smallest subject."""
    dated = records.where((F.col("topic") == "diary") & (F.coalesce("filed_at", F.lit("")) != ""))
    return dated.orderBy(F.desc("filed_at"), "subject").limit(1).select("date", "subject")


def global_section(records: DataFrame, most: int = 15) -> DataFrame:
    """One row with all records' number, and a line for each of the largest domains with its last day, then how many more
    there are."""
    domains = records.groupBy(named("domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.max(F.nullif("filed_at", F.lit(""))).alias("latest"))
    totals = domains.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("domains"))
    line = F.concat(F.lit("- "), "domain", F.lit(" — "), F.col("n").cast("string"), F.lit(" records · last "), F.coalesce(F.substring("latest", 1, 10), F.lit("unknown")))
    top = domains.orderBy(F.desc("n"), "domain").limit(most).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "domain", line.alias("line")))).alias("top"))
    more = F.when(F.col("domains") > most, F.concat(F.lit("\n(+"), (F.col("domains") - most).cast("string"), F.lit(" more)"))).otherwise("")
    text = F.concat(F.col("total").cast("string"), F.lit(" records\n"), F.array_join(F.transform("top", lambda t: t["line"]), "\n"), more)
    return totals.join(F.broadcast(top)).select("total", "domains", text.alias("section"))  # one row each


def trim(digest: Column, lines: int = MOST_LINES, size: int = MOST_BYTES) -> Column:
    """A digest within its limits of lines and UTF-8 bytes as it is; else as many whole lines as fit, and a mark."""
    parts = F.split(digest, "\n")
    whole = (F.size(parts) <= lines) & (F.octet_length(digest) <= size)
    first = F.slice(parts, 1, lines - 2)
    room = size - len(CUT.encode())
    # A line costs its bytes and the line end before it; the first has none.
    grown = F.aggregate(
        first,
        F.struct(F.lit(-1).alias("bytes"), F.lit(0).alias("kept")),
        lambda s, x: F.struct((s["bytes"] + 1 + F.octet_length(x)).alias("bytes"), F.when(s["bytes"] + 1 + F.octet_length(x) <= room, s["kept"] + 1).otherwise(s["kept"]).alias("kept")),
    )
    return F.when(whole, digest).otherwise(F.concat(F.array_join(F.slice(first, 1, grown["kept"]), "\n"), F.lit(CUT)))
