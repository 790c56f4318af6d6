"""What brings a found text nearer to a question, and how answers and evidence are counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shares of a distance that full overlaps take off, and that a text of the question's own room keeps.
KEYWORDS, QUOTED, NAMES, SAME_ROOM = 0.30, 0.60, 0.40, 0.8
#: Capitalised words that questions begin with, which are no names.
NOT_NAMES = ("What", "When", "Where", "Who", "How", "Which", "Did", "Do", "Was", "Were", "Have", "Has")


def quoted(question: Column) -> Column:
    """Phrases of 3 to 60 characters in single, then in double quotes."""
    found = F.concat(F.regexp_extract_all(question, F.lit("'([^']{3,60})'"), 1), F.regexp_extract_all(question, F.lit('"([^"]{3,60})"'), 1))
    return F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: F.length(p) >= 3)


def person_names(question: Column) -> Column:
    found = F.regexp_extract_all(question, F.lit(r"(?U)\b([A-Z][a-z]{2,15})\b"), 1)
    return F.filter(F.array_distinct(found), lambda n: ~n.isin(*NOT_NAMES))


def share(terms: Column, document: Column) -> Column:
    """The share of the terms that a document contains, whatever their case; 0 without terms or document."""
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(document), F.lower(t))))
    return F.when(document.isNotNull() & (F.size(terms) > 0), hits / F.size(terms)).otherwise(0.0)


def fused(distance: Column, keywords: Column, phrases: Column, names: Column) -> Column:
    """A distance less what the shares of keywords, quoted phrases and names take off, one after the other."""
    return distance * (1 - KEYWORDS * keywords) * (1 - QUOTED * phrases) * (1 - NAMES * names)


def room_distance(distance: Column, room: Column, asked: Column) -> Column:
    return F.when(room.eqNullSafe(asked) & room.isNotNull(), distance * SAME_ROOM).otherwise(distance)


def session_of(corpus_id: Column) -> Column:
    """The session of a session's or turn's id: what stands before its last '_turn_'."""
    return F.regexp_replace(corpus_id, r"(?s)\A(.*)_turn_.*\z", "$1")


def evidence_sessions(evidence: Column) -> Column:
    """Distinct sessions of pieces of evidence written 'D<number>:...'; others have none."""
    numbers = F.transform(evidence, lambda e: F.regexp_extract(e, r"\AD(\d+):", 1))
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n != ""), lambda n: F.concat(F.lit("session_"), n)))


def normal_answer(answer: Column) -> Column:
    """Without commas, articles, 'and' and punctuation, in lower case, with single blanks."""
    words = F.regexp_replace(F.replace(answer, F.lit(","), F.lit("")), r"(?U)\b(a|an|the|and)\b", " ")
    joined = F.trim(F.regexp_replace(words, r"(?U)\s+", " "))
    return F.trim(F.lower(F.regexp_replace(joined, r"\p{Punct}", "")))


def evidence_recall(retrieved: Column, evidence: Column) -> Column:
    """The share of the evidence, repeats included, that was retrieved; 1 where there is none to retrieve."""
    found = F.size(F.filter(evidence, lambda e: F.array_contains(retrieved, e)))
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, 1.0).otherwise(F.coalesce(found, F.lit(0)) / F.size(evidence))


def overlaps(text: Column, evidence: Column) -> Column:
    """Whether one of two texts, in lower case and stripped, contains the other; empty ones don't count."""
    a, b = F.trim(F.lower(text)), F.trim(F.lower(evidence))
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a)), F.lit(False))
