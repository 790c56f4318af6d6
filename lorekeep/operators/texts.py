"""Rule-based text operators: slices, exchanges, rejection of generated files, topics, names, sessions, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_slices(documents: DataFrame, size: int = 800, least: int = 30) -> DataFrame:
    """(id, slice_index, content): slices of ``size`` characters of texts with more than ``least``."""
    text = F.col("document")
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    slices = F.transform(starts, lambda i: F.substr(text, i * size + 1, F.lit(size)))
    return documents.where(F.length(F.trim(text)) > least).select("id", F.posexplode(slices).alias("slice_index", "content"))


def exchanges(turns: DataFrame) -> DataFrame:
    """Turns of sessions in units: each user turn opens one, which lasts until the next."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    numbered = turns.withColumn("exchange", F.sum((F.col("role") == "user").cast("int")).over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return numbered.groupBy("conv_id", "exchange").agg(F.count(F.lit(1)).alias("turns"), joined.alias("content")).where("exchange > 0")


def keyword_topic(text: Column, topics: dict[str, list[str]], head: int | None = 3000) -> Column:
    """The topic with most of its keywords in the first characters, or in all of the text; ties go to the first named, no
    hit to 'general'."""
    low = F.lower(text if head is None else F.substring(text, 1, head))
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    scored = [F.struct(count(words).alias("n"), F.lit(-k).alias("o"), F.lit(name).alias("topic")) for k, (name, words) in enumerate(topics.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["topic"]).otherwise("general")


def name_candidates(documents: DataFrame, least: int = 3, stop: tuple[str, ...] = ()) -> DataFrame:
    """Capitalised words that occur at least ``least`` times over all documents."""
    words = documents.select(F.explode(F.regexp_extract_all("document", F.lit("([A-Z][a-z]{2,19})"), 1)).alias("name"))
    return words.where(~F.col("name").isin(list(stop))).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def adherence(calls: DataFrame, reads: list[str], writes: list[str], closing: str) -> DataFrame:
    """Per session: calls, writes, whether a read came before the first write, the last tool, whether it closes."""
    is_read, is_write = F.col("tool").isin(reads), F.col("tool").isin(writes)
    grouped = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(is_write).alias("writes"),
        F.min(F.when(is_read, F.col("seq"))).alias("first_read"),
        F.min(F.when(is_write, F.col("seq"))).alias("first_write"),
        F.max_by("tool", "seq").alias("last_tool"),
    )
    before = F.when(F.col("first_write").isNotNull(), F.coalesce(F.col("first_read") < F.col("first_write"), F.lit(False)))
    at_end = F.when(F.col("first_write").isNotNull(), F.col("last_tool") == closing)
    return grouped.select("session_id", "calls", "writes", "last_tool", before.alias("read_before_write"), at_end.alias("closed"))


def save_triggers(turns: DataFrame, every: int) -> DataFrame:
    """Turns of users at which a multiple of ``every`` of them is reached in their session."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    users = turns.where("role = 'user'").withColumn("nth", F.row_number().over(order))
    return users.where(F.col("nth") % every == 0).select("conv_id", "turn", "nth")


def session_documents(turns: DataFrame) -> DataFrame:
    """The users' texts of each session, in order."""
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.array_join(said, "\n").alias("document"))


def token_f1(predicted: Column, truth: Column) -> Column:
    """F1 of the multisets of lower-case words; 0 without a common one."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    p, t = words(predicted), words(truth)
    times = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(times(p, w), times(t, w)))
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(t)))


def pivot_attributes(rows: DataFrame, document_key: str) -> DataFrame:
    """(id, key, value) rows to one row for each id: the document and the number of other attributes."""
    is_document = F.col("key") == document_key
    return rows.groupBy("id").agg(F.max(F.when(is_document, F.col("value"))).alias("document"), F.count_if(~is_document).alias("attributes"))


def source_groups(records: DataFrame, least: int = 5) -> DataFrame:
    """Sources with enough records to look for duplicates."""
    return records.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(F.col("n") >= least)
