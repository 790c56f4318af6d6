"""Names: which are valid, which rooms files belong to, and who speaks in a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The length and form of names, what bounds their tokens, how speakers are written, and who is no persona.
LONGEST_NAME = 128
SAFE_NAME = r"\A[a-zA-Z0-9_][a-zA-Z0-9_ .'\-]{0,127}\z"
SEPARATORS = r"[-_./ ]+"
SPEAKER = r"(?m)^([A-Z][A-Za-z0-9_-]{1,30}):"
SELF_NAMED = r"(?iU)\b(?:i am|i'm|call me)\s+([A-Z][A-Za-z0-9_-]{1,30})\b"
NO_PERSONAS = ("user", "assistant", "system", "human")
HEAD = 2000


def name_error(name: Column) -> Column:
    """Why a name is refused; null if it is good. Blanks around it don't count; a null is empty."""
    s = F.trim(F.coalesce(name, F.lit("")))
    path = s.contains("..") | s.contains("/") | s.contains("\\")
    return F.when(s == "", "empty").when(F.length(s) > LONGEST_NAME, "too long").when(path, "path").when(~s.rlike(SAFE_NAME), "characters")


def hinted(path: Column, hints: dict[str, str]) -> Column:
    """The domain of the longest hint that the path contains, whatever its case; of equally long ones the first."""
    low = F.lower(path)
    ranked = sorted(hints.items(), key=lambda h: -len(h[0]))
    return F.coalesce(F.lit(None).cast("string"), *(F.when(low.contains(h.lower()), domain) for h, domain in ranked))


def personas(text: Column) -> Column:
    """Distinct names of those who speak ('Name:' at the start of a line), then of those who name themselves, in order."""
    found = F.concat(F.regexp_extract_all(text, F.lit(SPEAKER), 1), F.regexp_extract_all(text, F.lit(SELF_NAMED), 1))
    return F.array_distinct(F.filter(found, lambda n: ~F.lower(n).isin(*NO_PERSONAS)))


def name_matches(part: Column, name: str) -> Column:
    """Equal, or one is a token of the other; both in lower case."""
    name = name.lower()
    own = [t for t in re.split(SEPARATORS, name) if t]
    return (part == name) | F.array_contains(F.split(part, SEPARATORS), name) | part.isin(own)


def occurrences(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def room_of(path: Column, text: Column, rooms: dict[str, list[str]], head: int | None = HEAD) -> Column:
    """The room of a file in a project: by its folders from the top, its name, or the room whose words its text (its first
    ``head`` characters, or all of it) has most of; 'general' without any. Ties go to the room named first."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    folders, stem = F.slice(parts, 1, F.size(parts) - 1), F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]+\z", "")
    fits = lambda part: F.coalesce(F.lit(None).cast("string"), *(F.when(F.greatest(F.lit(False), *(name_matches(part, w) for w in (room, *words))), room) for room, words in rooms.items()))
    by_folder = F.get(F.filter(F.transform(folders, fits), lambda r: r.isNotNull()), 0)
    by_name = F.coalesce(F.lit(None).cast("string"), *(F.when(name_matches(stem, room), room) for room in rooms))
    low = F.lower(text if head is None else F.substring(text, 1, head))
    counted = [F.struct(sum((occurrences(low, w.lower()) for w in (*words, room)), F.lit(0)).alias("n"), F.lit(-k).alias("o"), F.lit(room).alias("room")) for k, (room, words) in enumerate(rooms.items())]
    best = F.array_max(F.array(*counted))
    return F.coalesce(by_folder, by_name, F.when(best["n"] > 0, best["room"]), F.lit("general"))


def proposed_rooms(paths, folders: dict[str, str], least: int = 2, most: int = 6):
    """(room, n) of a column ``path``: rooms whose folder words occur in file names, by how many words of files hit them.

    Ties go by name. Each word that a name contains counts once; rooms under ``least`` hits go.
    """
    name = F.replace(F.replace(F.lower(F.regexp_extract("path", r"([^/]*)\z", 1)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    hits = F.array_compact(F.array(*(F.when(name.contains(word), F.lit(room)) for word, room in folders.items())))
    found = paths.select(F.explode(hits).alias("room")).groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "room").limit(most)


def utc_micros(raw: Column) -> Column:
    """An ISO time as microseconds since 1970: without an offset it is in UTC; empty, it is before all others.

    Null for what is no time.
    """
    stamped = F.when(raw.rlike(r"(?:Z|[+-]\d{2}:?\d{2})\z"), raw).otherwise(F.concat(raw, F.when(raw.rlike(r"[T ]"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(-(2**63) + 1)).otherwise(F.unix_micros(F.try_to_timestamp(stamped)))
