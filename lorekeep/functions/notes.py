"""Structured notes as one line each, ``id:names|topics|"quote"|weight|tones|flags``, and such lines read back into their fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.noise import strip
from lorekeep.functions.once import once

# Tones with their codes, words that make a quote weigh more, flags in their order, and what patterns quotes follow.
TONES = {
    "vulnerability": "vul",
    "vulnerable": "vul",
    "joy": "joy",
    "joyful": "joy",
    "fear": "fear",
    "mild_fear": "fear",
    "trust": "trust",
    "trust_building": "trust",
    "grief": "grief",
    "raw_grief": "grief",
    "wonder": "wonder",
    "philosophical_wonder": "wonder",
    "rage": "rage",
    "anger": "rage",
    "love": "love",
    "devotion": "love",
    "hope": "hope",
    "despair": "despair",
    "hopelessness": "despair",
    "peace": "peace",
    "relief": "relief",
    "humor": "humor",
    "dark_humor": "humor",
    "tenderness": "tender",
    "raw_honesty": "raw",
    "brutal_honesty": "raw",
    "self_doubt": "doubt",
    "anxiety": "anx",
    "exhaustion": "exhaust",
    "conviction": "convict",
    "quiet_passion": "passion",
    "warmth": "warmth",
    "curiosity": "curious",
    "gratitude": "grat",
    "frustration": "frust",
    "confusion": "confuse",
    "satisfaction": "satis",
    "excitement": "excite",
    "determination": "determ",
    "surprise": "surprise",
}
FELT = (
    "love", "fear", "remember", "soul", "feel", "stupid", "scared", "beautiful", "destroy", "respect", "trust", "consciousness", "alive",
    "forget", "waiting", "peace", "matter", "real", "guilt", "escape", "rest", "hope", "dream", "lost", "found",
)
FLAGS = ("ORIGIN", "SENSITIVE", "CORE", "GENESIS", "PIVOT")
QUOTED = (
    r'"([^"]{8,55})"',
    r"(?:^|[\s(])'([^']{8,55})'(?:[\s.,;:!?)]|$)",
    r"""(?i)(?:says?|said|articulates?|reveals?|admits?|confesses?|asks?):\s*["']?([^.!?]{10,55})[.!?]""",
)

NOTE = r'(?s)^([^:|]*):([^|]*)\|([^|]*)(?:\|"(.*)")?\|(-?[0-9][0-9.]*(?:E-?[0-9]+)?)(?:\|([^|]*))?(?:\|([^|]*))?$'
LINK = r"^T:([^|]*?)<->([^|]*)\|(.*)$"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _plain(part: Column, marks: str = r"[|\r\n]") -> Column:
    """What parts fields or lines would break a line inside a field: it becomes a blank."""
    return F.regexp_replace(part, marks, " ")


def _last(note_id: Column) -> Column:
    return _plain(F.element_at(F.split(_text(note_id), "-"), -1), r"[:|\r\n]")


def name_code(name: Column, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> Column:
    """The code of a name: null for one with a skipped name in it, else that of the same known name, in its own case or in lower case,
    else of the first known name in it, else its first three letters as capitals."""
    low, own = F.lower(name), F.upper(F.substring(name, 1, 3))
    pairs = {k: code for full, code in (known or {}).items() for k in (full, full.lower())}
    if pairs:
        codes = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
        inside = F.filter(F.array(*(F.struct(F.lit(k.lower()).alias("k"), F.lit(c).alias("c")) for k, c in pairs.items())), lambda p: low.contains(p["k"]))
        own = F.coalesce(F.element_at(codes, name), F.element_at(codes, low), F.get(inside, 0)["c"], own)
    if skip:
        own = F.when(~F.exists(F.array(*(F.lit(s.lower()) for s in skip)), lambda s: low.contains(s)), own)
    return _plain(own)


def name_codes(people: Column, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> Column:
    """The distinct codes of people in order of their letters; empty without any."""
    people = F.array_compact(F.coalesce(people, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(people, lambda p: name_code(p, known, skip)))))


def tone_codes(tones: Column, most: int = 3) -> Column:
    """The first distinct codes; an unknown tone is its first four letters."""
    codes = F.create_map(*(F.lit(x) for pair in TONES.items() for x in pair))
    tones = F.array_compact(F.coalesce(tones, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.transform(tones, lambda t: _plain(F.coalesce(F.element_at(codes, t), F.substring(t, 1, 4))))), 1, most)


def flags() -> Column:
    """A note's flags by its origin, sensitivity and remarks."""
    remarks = F.lower(_text(F.col("notes")))
    found = (
        F.coalesce(F.col("origin_moment"), F.lit(False)),
        F.upper(_text(F.col("sensitivity"))).startswith("MAXIMUM"),
        remarks.contains("foundational pillar") | remarks.contains("core"),
        remarks.contains("genesis") | F.lower(_text(F.col("origin_label"))).contains("genesis"),
        remarks.contains("pivot"),
    )
    return F.array_compact(F.array(*(F.when(is_so, flag) for flag, is_so in zip(FLAGS, found, strict=True))))


def _weight_of_quote(quote: Column) -> Column:
    felt = once(F.lower(quote), lambda low: sum((F.when(low.contains(w), 2).otherwise(0) for w in FELT), F.lit(0)))
    return felt + F.when(quote.rlike(r"^\p{Lu}"), 2).otherwise(0) + F.when(F.length(quote) > 20, 1).otherwise(0) - F.when(quote.rlike("^(?:The|This|She) "), 2).otherwise(0)


def key_quote() -> Column:
    """The quote that weighs most, the first of equals, of a note's content, origin and remarks; without one, what its title says
    behind a dash; else empty. Quotes of the kinds in ``QUOTED`` come one kind after the other."""
    said = F.concat_ws(" ", *(_text(F.col(c)) for c in ("content", "origin_label", "notes")))
    quotes = F.concat(*(F.regexp_extract_all(said, F.lit(pattern), 1) for pattern in QUOTED))
    long = F.filter(F.transform(quotes, strip), lambda q: F.length(q) >= 8)
    best = F.array_max(F.transform(long, lambda q, k: F.struct(_weight_of_quote(q).alias("weight"), (-k).alias("place"), q.alias("quote"))))["quote"]
    return _plain(F.coalesce(best, F.substring(after_dash(F.col("title")), 1, 45), F.lit("")), r"[\r\n]")


def after_dash(title: Column) -> Column:
    """What stands behind the first `` - ``; null without one."""
    return F.when(title.contains(" - "), F.element_at(F.split(title, " - ", 2), 2))


def some(codes: Column, otherwise: str | None = "???") -> Column:
    return F.when(F.size(codes) > 0, F.array_join(codes, "+")).otherwise(F.lit(otherwise))


def topic(topics: Column) -> Column:
    """The first two topics; ``misc`` without any."""
    named = F.slice(F.coalesce(topics, F.array().cast("array<string>")), 1, 2)
    return F.when(F.size(named) > 0, _plain(F.array_join(named, "_"))).otherwise("misc")


def weight() -> Column:
    return F.coalesce(F.col("weight"), F.lit(0.5)).cast("double")


def note_line(known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> Column:
    """A note's line. A null field is an absent one; a weight is half without one; an empty part is left out."""
    quote = once(key_quote(), lambda q: F.when(q != "", F.concat(F.lit('"'), q, F.lit('"'))))
    return F.concat_ws(
        "|",
        F.concat(_last(F.col("note_id")), F.lit(":"), some(name_codes(F.col("people"), known, skip))),
        topic(F.col("topics")),
        quote,
        weight().cast("string"),
        some(tone_codes(F.col("tones")), None),
        some(flags(), None),
    )


def link_label(label: Column, most: int = 30) -> Column:
    """A label up to its first colon; without one, its first characters."""
    label = _text(label)
    return _plain(F.when(label.contains(":"), F.substring_index(label, ":", 1)).otherwise(F.substring(label, 1, most)))


def link_line(from_id: Column, to_id: Column, label: Column) -> Column:
    return F.concat(F.lit("T:"), _last(from_id), F.lit("<->"), _last(to_id), F.lit("|"), link_label(label))


def parsed(line: Column) -> Column:
    """What a line says: its ``kind`` (arc, link, note, header; null for another line) and its fields, null where the kind has none.

    A quote may hold bars and quotation marks, as it ends at the last mark before the weight. One part behind the weight is flags if
    all of it are flags, else tones. An arc that begins a file reads as an arc even where it looks like a note.
    """
    part = lambda k: F.regexp_extract(line, NOTE, k)
    split = lambda c, mark: F.filter(F.split(c, mark), lambda x: x != "")
    kind = F.when(line.startswith("ARC:"), "arc").when(line.rlike(LINK), "link").when(line.rlike(NOTE), "note").when(line.contains("|"), "header")
    is_ = lambda k, c: F.when(kind == k, c)
    ends = F.when(part(7) != "", F.array(part(6), part(7))).otherwise(F.when(part(6).rlike(rf"^(?:{'|'.join(FLAGS)})(?:\+(?:{'|'.join(FLAGS)}))*$"), F.array(F.lit(""), part(6))).otherwise(F.array(part(6), F.lit(""))))
    head = F.split(line, r"\|", 4)
    return F.struct(
        kind.alias("kind"),
        is_("arc", F.substr(line, F.lit(5))).alias("arc"),
        is_("link", F.regexp_extract(line, LINK, 1)).alias("from_id"),
        is_("link", F.regexp_extract(line, LINK, 2)).alias("to_id"),
        is_("link", F.regexp_extract(line, LINK, 3)).alias("label"),
        is_("note", part(1)).alias("note_id"),
        F.when(kind == "note", split(part(2), r"\+")).when(kind == "header", split(F.get(head, 1), r"\+")).alias("names"),
        is_("note", part(3)).alias("topic"),
        is_("note", part(4)).alias("quote"),
        is_("note", part(5).try_cast("double")).alias("weight"),
        is_("note", split(ends[0], r"\+")).alias("tones"),
        is_("note", split(ends[1], r"\+")).alias("flags"),
        is_("header", F.get(head, 0)).alias("number"),
        is_("header", F.get(head, 2)).alias("date"),
        is_("header", F.get(head, 3)).alias("title"),
    )
