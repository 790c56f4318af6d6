"""Files of structured notes as lines, all files as one archive, and the digest of the weightiest notes by date.

Notes are rows (file, position, note_id, people, topics, content, title, origin_label, notes, weight, tones, origin_moment, sensitivity, date);
links are rows (file, position, from_id, to_id, label); arcs are rows (file, arc). Lines stay rows with the keys that order them, so that
no task needs a whole file: a range-partitioned sort writes them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.engine.shared import store
from lorekeep.functions import notes as N
from lorekeep.functions.noise import strip

HEADER, ARC, NOTE, LINK, END = range(5)
ORDER = ("file", "part", "position")


def headers(notes: DataFrame, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(file, line): number, first three codes of all people, date of the first note, title. Codes are made distinct before they are
    ranked, so a file with many notes is no task of its own."""
    codes = notes.select("file", F.explode(N.name_codes(F.col("people"), known, skip)).alias("code")).distinct()
    first = codes.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("code"))).where("k <= 3")
    names = first.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("code")), "+").alias("names"))
    file = F.col("file")
    dashed = file.contains("-")
    number = F.when(dashed, F.substring_index(file, "-", 1)).otherwise("000")
    title = F.when(dashed, strip(F.element_at(F.split(F.replace(file, F.lit(".txt"), F.lit("")), "-", 2), -1))).otherwise(file)
    line = F.concat_ws("|", F.regexp_replace(number, r"[:|\r\n]", " "), F.coalesce("names", F.lit("???")), F.regexp_replace("date", r"[|\r\n]", " "), F.regexp_replace(title, r"[\r\n]", " "))
    return dates(notes).join(names, "file", "left").select("file", line.alias("line"))


def dates(notes: DataFrame) -> DataFrame:
    """(file, date) of each file's first note; ``unknown`` without one."""
    return notes.groupBy("file").agg(F.coalesce(F.min_by("date", F.struct("position", "note_id")), F.lit("unknown")).alias("date"))


def lines(notes: DataFrame, links: DataFrame | None = None, arcs: DataFrame | None = None, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(file, part, position, line): each file's header, its arc if it isn't empty, its notes and its links. Notes with a null ``file``
    are in none."""
    notes = notes.where("file IS NOT NULL")
    row = lambda df, part, place, line: df.select("file", F.lit(part).alias("part"), place.cast("long").alias("position"), line.alias("line"))
    found = row(headers(notes, known, skip), HEADER, F.lit(0), F.col("line")).unionByName(row(notes, NOTE, F.col("position"), N.note_line(known, skip)))
    if arcs is not None:
        found = found.unionByName(row(arcs.where("arc <> ''"), ARC, F.lit(0), F.concat(F.lit("ARC:"), F.regexp_replace("arc", r"[\r\n]", " "))))
    if links is not None:
        found = found.unionByName(row(links, LINK, F.col("position"), N.link_line(F.col("from_id"), F.col("to_id"), F.col("label"))))
    return found


def archive(file_lines: DataFrame) -> DataFrame:
    """All files' lines in the order of their names, each file closed by a line of dashes; sorted by ranges, to be written as text.
    Lines are stored first: their files, the sort's sample and the sort itself would make them anew each."""
    file_lines = store(file_lines, "notes-lines")
    ends = file_lines.select("file").distinct().select("file", F.lit(END).alias("part"), F.lit(0).cast("long").alias("position"), F.lit("---").alias("line"))
    return file_lines.unionByName(ends).orderBy(*ORDER)


def decode(file_lines: DataFrame) -> DataFrame:
    """The fields of each line beside the keys it has."""
    return file_lines.withColumn("f", N.parsed(F.col("line"))).select(*(c for c in file_lines.columns if c != "line"), "f.*")


def moments(notes: DataFrame, least: float = 0.85, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(date, weight, file, position, line) of notes that weigh so much, or that tell of an origin, a core or a genesis.

    The date is that of the file's first note, up to a comma. To be read by date, falling weight, file and position: a note without a
    weight comes last, though its line says half.
    """
    notes = notes.where("file IS NOT NULL")
    day = dates(notes).select("file", strip(F.substring_index("date", ",", 1)).alias("_day"))
    found = notes.withColumn("_flags", N.flags())
    kept = found.where((F.coalesce("weight", F.lit(0.0)) >= least) | F.arrays_overlap("_flags", F.array(F.lit("ORIGIN"), F.lit("CORE"), F.lit("GENESIS"))))
    codes = F.filter(N.name_codes(F.col("people"), known, skip), lambda c: c != "")
    hint = F.coalesce(F.substring(N.after_dash(F.col("title")), 1, 30), F.array_join(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 2), "_"))
    quote, secret = N.key_quote(), F.coalesce("sensitivity", F.lit(""))
    line = F.concat_ws(
        "|",
        N.some(codes),
        F.nullif(F.regexp_replace(hint, r"[|\r\n]", " "), F.lit("")),
        F.when((quote != "") & (quote != hint) & (quote != F.coalesce("title", F.lit(""))), F.concat(F.lit('"'), quote, F.lit('"'))),
        F.when((secret != "") & ~F.array_contains("_flags", "SENSITIVE"), "SENSITIVE"),
        N.weight().cast("string"),
        N.some(F.col("_flags"), None),
    )
    return kept.join(day, "file").select(F.col("_day").alias("date"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "file", "position", line.alias("line"))


def digest(notes: DataFrame, links: DataFrame | None = None, sections: dict[str, list[str]] | None = None, least: float = 0.85, most_links: int = 8, **names) -> DataFrame:
    """(part, date, place, line): who one is, then the moments under their dates, then the first links' labels; ``place`` orders the lines of
    a part and date. The rows come in that order."""
    found = moments(notes, least, **names)
    spark = notes.sparkSession
    key = lambda head, w, file, position: F.struct(F.lit(head).alias("head"), w.alias("weight"), file.alias("file"), position.cast("long").alias("position"))
    blank = (F.lit(0.0), F.lit(""))
    rows = lambda df, part, date, place, line: df.select(F.lit(part).alias("part"), date.alias("date"), place.alias("place"), line.alias("line"))
    out = rows(found.select("date").distinct(), 1, F.col("date"), key(0, *blank, F.lit(0)), F.concat(F.lit("=MOMENTS["), "date", F.lit("]=")))
    out = out.unionByName(rows(found, 1, F.col("date"), key(1, -F.col("weight"), F.col("file"), F.col("position")), F.col("line")))
    told = [line for name, text in (sections or {}).items() for line in (f"={name}=", *text)]
    if told:
        said = spark.createDataFrame(list(enumerate(told)), "k long, line string")
        out = out.unionByName(rows(said, 0, F.lit(""), key(1, *blank, F.col("k")), F.col("line")))
    if links is not None:
        first = links.orderBy("file", "position").limit(most_links).select("file", "position", N.link_label(F.col("label"), 40).alias("line"))
        out = out.unionByName(rows(first.limit(1), 2, F.lit(""), key(0, *blank, F.lit(0)), F.lit("=TUNNELS=")))
        out = out.unionByName(rows(first, 2, F.lit(""), key(1, F.lit(0.0), F.col("file"), F.col("position")), F.col("line")))
    return out.orderBy("part", "date", "place")
