"""Concatenated transcripts split into their sessions, file by file, without a task that holds a file.

Spark reads a file in splits. Lines are numbered inside their split and get their place in the file from the lines of the splits before
it (one row for each split). A line that holds the header of a session begins one, unless it or one of the five after it says that
older messages are shown again; headers and such lines are rare, and meet by their numbers across splits. What
session a line belongs to is carried along inside a split, and into it from the last beginning before it.

Defined results: lines before the first beginning belong to no session; a file with fewer than two beginnings is no concatenation and
gives none; sessions under ``LEAST`` lines are left out; empty files have no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.engine.shared import small, store

# What shows older messages again, how many lines from a header on may say so, and the least lines of a session.
AGAIN, NEAR, LEAST = ("Ctrl+E", "previous messages"), 6, 10
#: How a time is written, in how many lines it and names are looked for, and what no subject begins with.
STAMP, STAMPED, NAMED = r"⏺\s+(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})", 50, 100
COMMANDS = r"\A(?:\./|cd |ls |python|bash|git |cat |source |export |claude|./activate)"
MONTHS = "January February March April May June July August September October November December".split()
LONGEST = 60


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, split, n, line) of text files: n counts from 0 through each file. Stored."""
    read = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    held = store(read.withColumn("at", F.monotonically_increasing_id()), "session-lines")
    sizes = held.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each split of a file.
    starts = sizes.select("file", "split", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return held.join(small(store(starts, "session-splits")), ["file", "split"]).select("file", "split", (F.col("at") + F.col("shift")).alias("n"), F.col("value").alias("line"))


def beginnings(numbered: DataFrame, header: str) -> DataFrame:
    """(file, start, session): the lines with ``header`` that begin a session, numbered from 0 in each file that has two or more."""
    heads = numbered.where(F.contains("line", F.lit(header))).select("file", F.col("n").alias("start"))
    shown = numbered.where(F.contains("line", F.lit(AGAIN[0])) | F.contains("line", F.lit(AGAIN[1]))).select("file", "n")
    near = heads.select("file", "start", F.explode(F.sequence(F.col("start"), F.col("start") + NEAR - 1)).alias("n"))
    kept = heads.join(near.join(shown, ["file", "n"]).select("file", "start"), ["file", "start"], "left_anti")
    order = Window.partitionBy("file").orderBy("start")
    counted = kept.withColumn("session", (F.row_number().over(order) - 1).cast("int")).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("file")))
    return counted.where("all >= 2").select("file", "start", "session")


def sessions(numbered: DataFrame, header: str) -> DataFrame:
    """(file, session, place, line): each line of a session with its place in it. ``numbered`` comes from ``lines``."""
    numbered = store(numbered, "session-numbered")
    begins = store(beginnings(numbered, header), "session-begins")
    marked = numbered.join(small(begins.withColumnRenamed("start", "n")), ["file", "n"], "left")
    here = F.when(F.col("session").isNotNull(), F.struct(F.col("n").alias("start"), "session"))
    # The last beginning of each split, carried into those after it: one row for each split.
    ends = marked.groupBy("file", "split").agg(F.max(here).alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = store(ends.select("file", "split", F.max("last").over(before).alias("carried")), "session-carried")
    inside = Window.partitionBy("file", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    of = marked.withColumn("of", F.max(here).over(inside)).join(small(carried), ["file", "split"])
    of = of.withColumn("of", F.coalesce("of", "carried")).where("of IS NOT NULL")
    placed = of.select("file", F.col("of.session").alias("session"), (F.col("n") - F.col("of.start")).alias("place"), "line")
    long = placed.groupBy("file", "session").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LEAST).select("file", "session")
    return placed.join(long, ["file", "session"])


def described(found: DataFrame, names: list[str]) -> DataFrame:
    """(file, session, size, stamp, day, people, subject) of ``sessions``: the first time among its first lines, those of ``names`` that its
    beginning holds as words, and the first thing a user said that is no command, fit for a file's name."""
    clock = lambda k: F.regexp_extract("line", STAMP, k)
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), clock(2)).cast("string"), 2, "0")
    day = F.concat_ws("-", clock(4), month, F.lpad(clock(3), 2, "0"))
    stamp = F.struct("place", F.concat_ws("_", day, F.regexp_replace(clock(1), r"[:\s]", "")).alias("stamp"), day.alias("day"))
    said = F.trim(F.substr("line", F.lit(3)))
    good = F.startswith("line", F.lit("> ")) & (F.length(said) > 5) & ~said.rlike(COMMANDS)
    subject = F.left(F.regexp_replace(F.trim(F.regexp_replace(said, r"(?U)[^\w\s-]", "")), r"\s+", "-"), F.lit(LONGEST))
    people = [F.max(F.when((F.col("place") < NAMED) & F.col("line").rlike(rf"(?iU)\b\Q{n}\E\b"), F.lit(n))) for n in sorted(names)]
    first = found.groupBy("file", "session").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.when((F.col("place") < STAMPED) & F.col("line").rlike(STAMP), stamp)).alias("s"),
        F.array_compact(F.array(*people)).alias("people") if people else F.array().cast("array<string>").alias("people"),
        F.min(F.when(good, F.struct("place", subject.alias("subject")))).alias("u"),
    )
    return first.select("file", "session", "size", F.col("s.stamp").alias("stamp"), F.col("s.day").alias("day"), "people", F.coalesce("u.subject", F.lit("session")).alias("subject"))
