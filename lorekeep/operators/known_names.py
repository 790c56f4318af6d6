"""A registry of people and projects: which of them texts name, in one pass over each text however many names there are.

All names and aliases make one Aho-Corasick automaton, which a worker builds once and runs over each text. A name that is also a
common word is only a name where the patterns around it speak for a person more often than against; those patterns are looked up
in the few texts that hold such a word.

A registry is a table (name, kind, aliases, source, confidence, contexts, relationship, ambiguous). It is broadcast in blocks of
``NAMES`` names: larger ones take one pass over the texts for each block. Names match in any case between ends of words.

Defined results: null texts name nobody; null and empty names are left out; rows of texts that repeat an id give a name once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.engine.shared import small, store
from lorekeep.functions import people as P

#: Names that go into one automaton.
NAMES = 200_000
# Words that are common beside being names, or that begin sentences.
COMMON = (
    "ever", "grace", "will", "bill", "mark", "april", "may", "june", "joy", "hope", "faith", "chance", "chase", "hunter", "dash", "flash",
    "star", "sky", "river", "brook", "lane", "art", "clay", "gil", "nat", "max", "rex", "ray", "jay", "rose", "violet", "lily", "ivy", "ash", "reed", "sage",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "july", "august", "september", "october", "november", "december",
)
# What around a word (@) speaks for a person, and what against.
FOR = (
    r"\b@\s+said\b", r"\b@\s+told\b", r"\b@\s+asked\b", r"\b@\s+laughed\b", r"\b@\s+smiled\b", r"\b@\s+was\b", r"\b@\s+is\b", r"\b@\s+called\b", r"\b@\s+texted\b",
    r"\bwith\s+@\b", r"\bsaw\s+@\b", r"\bcalled\s+@\b", r"\btook\s+@\b", r"\bpicked\s+up\s+@\b", r"\bdrop(?:ped)?\s+(?:off\s+)?@\b", r"\b@(?:'s|s')\b", r"\bhey\s+@\b", r"\bthanks?\s+@\b",
    r"^@[:\s]", r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+@\b",
)
AGAINST = (
    r"\bhave\s+you\s+@\b", r"\bif\s+you\s+@\b", r"\b@\s+since\b", r"\b@\s+again\b", r"\bnot\s+@\b", r"\b@\s+more\b", r"\bwould\s+@\b", r"\bcould\s+@\b", r"\bwill\s+@\b",
    r"(?:the\s+)?@\s+(?:of|in|at|for|to)\b",
)
#: The confidence from which on a learned name is kept, and how often a text has to hold it.
SURE, OFTEN = 0.75, 3
REGISTRY = "name string, kind string, aliases array<string>, source string, confidence double, contexts array<string>, relationship string, ambiguous boolean"
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def is_common(name: Column, common: Iterable[str] = COMMON) -> Column:
    return F.lower(name).isin(*common)


def seeded(people: DataFrame, projects: DataFrame, aliases: DataFrame, common: Iterable[str] = COMMON) -> DataFrame:
    """The registry of (name, relationship, context), project names (name) and (alias, name): an alias is a person of its own, whose
    alias the name is. Of a name that repeats one row stays, with the first of what the others say; of several aliases of one name the first in order counts."""
    people = people.select(F.trim("name").alias("name"), F.coalesce("relationship", F.lit("")).alias("relationship"), F.coalesce("context", F.lit("personal")).alias("context"))
    people = people.where("name <> ''").groupBy("name").agg(F.min("relationship").alias("relationship"), F.min("context").alias("context"))
    lead = aliases.where("alias <> ''").groupBy("name").agg(F.min("alias").alias("alias"))
    both = people.join(lead, "name", "left")
    own = both.select("name", F.when(F.col("alias").isNull(), F.array().cast("array<string>")).otherwise(F.array("alias")).alias("aliases"), "relationship", "context")
    other = both.where("alias IS NOT NULL").groupBy("alias").agg(F.array_sort(F.collect_set("name")).alias("aliases"), F.min("relationship").alias("relationship"), F.min("context").alias("context"))
    rows = own.unionByName(other.withColumnRenamed("alias", "name").join(people.select("name"), "name", "left_anti"))
    persons = rows.select("name", F.lit("person").alias("kind"), "aliases", F.lit("onboarding").alias("source"), F.lit(1.0).alias("confidence"), F.array("context").alias("contexts"), "relationship", is_common(F.col("name"), common).alias("ambiguous"))
    named = projects.where("name <> ''").select("name").distinct()
    none = F.array().cast("array<string>")
    return persons.unionByName(named.select("name", F.lit("project").alias("kind"), none.alias("aliases"), F.lit("onboarding").alias("source"), F.lit(1.0).alias("confidence"), none.alias("contexts"), F.lit("").alias("relationship"), F.lit(False).alias("ambiguous")))


def called(registry: DataFrame) -> DataFrame:
    """(key, name, kind, ambiguous): every lower-case name and alias with the entries it stands for. A key is ambiguous if an entry of
    that name is."""
    keys = registry.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key"), "name", "kind").select(F.lower("key").alias("key"), "name", "kind").where("key <> ''").distinct()
    flagged = registry.where("ambiguous").select(F.lower("name").alias("key")).distinct().withColumn("ambiguous", F.lit(True))
    return keys.join(flagged, "key", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def level(text: str) -> str:
    """The lower-case text with every character in its place; the few whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place of a text."""
    inside = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    return inside(at - 1) != inside(at)


def _sides(pattern: str) -> tuple[list[re.Pattern] | str, re.Pattern]:
    """What a pattern asks for in front of the name, and behind it. In front that is an edge of a word, the text's start, nothing, or
    expressions that end where the name begins, one for each way of an optional end."""
    left, right = pattern.split("@")
    left = "" if left.endswith(r"(?:the\s+)?") else left
    ways = [left.replace(OFF, ""), left.replace(OFF, r"off\s+")] if OFF in left else [left]
    return left if left in ("", "^", r"\b") else [re.compile(way) for way in ways], re.compile(right)


OFF = r"(?:off\s+)?"
SIDES = tuple([_sides(p) for p in kind] for kind in (FOR, AGAINST))
_BOUND = re.compile(r"\b")


class Votes:
    """How many patterns around a lower-case name speak for a person in one lower-case text, and how many against. Patterns are
    split at the name, so that they are the same for all names, and what stands in front is found once in a text."""

    def __init__(self, low: str) -> None:
        self.low, self.ends = low, {}

    def _before(self, ways: list[re.Pattern]) -> set[int]:
        if ways[0] not in self.ends:
            self.ends[ways[0]] = {m.end() for way in ways for m in way.finditer(self.low)}
        return self.ends[ways[0]]

    def _fits(self, side: tuple, places: list[tuple[int, bool]], size: int) -> bool:
        left, right = side
        if isinstance(left, list):
            before = self._before(left)
            return bool(before) and any(at in before and right.match(self.low, at + size) for at, _ in places)
        return any((left == "" or (at == 0 if left == "^" else bound)) and right.match(self.low, at + size) for at, bound in places)

    def of(self, name: str) -> tuple[int, int]:
        if name[:1].isspace():  # blanks in front of it may be the pattern's or its own
            return tuple(sum(re.search(p.replace("@", re.escape(name)), self.low) is not None for p in kind) for kind in (FOR, AGAINST))
        places, at = [], self.low.find(name)
        while at >= 0:
            places.append((at, _BOUND.match(self.low, at) is not None))
            at = self.low.find(name, at + 1)
        return tuple(sum(self._fits(side, places, len(name)) for side in kind) for kind in SIDES)


def votes(name: str, low: str) -> tuple[int, int]:
    """The votes about one name in one text."""
    return Votes(low).of(name)


def mentions(texts: DataFrame, registry: DataFrame, id_col: str = "id", text_col: str = "document") -> DataFrame:
    """(id, key, persons, concepts): each name or alias that a text holds as a word, with the votes where it is ambiguous (else 0)."""
    keys = store(called(registry).groupBy("key").agg(F.max("ambiguous").alias("ambiguous")), "names-keys")
    blocks = max(-(-keys.count() // NAMES), 1)
    parts = [keys if blocks == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k) for k in range(blocks)]
    return reduce(DataFrame.unionByName, (_block(texts, part, id_col, text_col) for part in parts))


def _block(texts: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = keys.toPandas()  # at most about NAMES
    shared = texts.sparkSession.sparkContext.broadcast(dict(zip(rows["key"], rows["ambiguous"].astype(bool), strict=True)))
    kind, token = texts.schema[id_col].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ambiguous = shared.value
        if token not in _AUTOMATA and ambiguous:
            automaton = ahocorasick.Automaton()
            for key in ambiguous:
                automaton.add_word(key, key)
            automaton.make_automaton()
            _AUTOMATA.clear()
            _AUTOMATA[token] = automaton
        for batch in batches:
            at, found, pro, contra = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist() if ambiguous else ()):
                low = level(text or "")
                here = {key for end, key in _AUTOMATA[token].iter(low) if _edge(low, end + 1) and _edge(low, end + 1 - len(key))}
                said = Votes(low)
                for key in sorted(here):
                    persons, concepts = said.of(key) if ambiguous[key] else (0, 0)
                    for column, value in zip((at, found, pro, contra), (row, key, persons, concepts), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.utf8()), pa.array(pro, pa.int32()), pa.array(contra, pa.int32())], names=["id", "key", "persons", "concepts"])

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, key string, persons int, concepts int")


def people_in(texts: DataFrame, registry: DataFrame, id_col: str = "id", text_col: str = "document") -> DataFrame:
    """(id, name): the registered people that texts name by name or alias; an ambiguous name needs more votes for it than against."""
    who = store(called(registry).where("kind = 'person'"), "names-called")
    found = mentions(texts, registry, id_col, text_col).join(small(who), "key").where(~F.col("ambiguous") | (F.col("persons") > F.col("concepts")))
    return found.select("id", "name").distinct()


def looked_up(words: DataFrame, registry: DataFrame, word_col: str = "word", context_col: str = "context") -> DataFrame:
    """``words`` with (kind, confidence, source, name, decided): what the registry says of a word, people before projects, and the first
    name in order if several fit. In a context an ambiguous name is what its votes say; a tie leaves it the person it is."""
    rows = words.withColumn("_row", F.monotonically_increasing_id())
    rows = store(rows.withColumn("_low", F.lower(word_col)), "names-words")
    of = called(registry).join(registry.select("name", "source", "confidence", "kind"), ["name", "kind"])
    best = of.groupBy("key").agg(F.min(F.struct("kind", "name", "source", "confidence", "ambiguous")).alias("e"))
    voted = mentions(rows.where(F.col(context_col) != "").select("_row", context_col), registry, "_row", context_col)
    voted = voted.select(F.col("id").alias("_row"), F.col("key").alias("_low"), "persons", "concepts")
    met = rows.join(best.withColumnRenamed("key", "_low"), "_low", "left").join(voted, ["_row", "_low"], "left")
    lead = F.when((F.col("e.kind") == "person") & F.col("e.ambiguous"), F.col("persons") - F.col("concepts"))
    kind = F.when(lead < 0, "concept").when(F.col("e").isNull(), "unknown").otherwise(F.col("e.kind"))
    sure = F.when(lead > 0, F.least(F.lit(0.95), 0.7 + F.col("persons") * 0.1)).when(lead < 0, F.least(F.lit(0.9), 0.7 + F.col("concepts") * 0.1)).otherwise(F.coalesce("e.confidence", F.lit(0.0)))
    source = F.when(lead < 0, "context_disambiguated").otherwise(F.coalesce("e.source", F.lit("none")))
    name = F.when((lead != 0) | F.col("e").isNull(), F.col(word_col)).otherwise(F.col("e.name"))
    return met.select(*words.columns, kind.alias("kind"), F.round(sure, 2).alias("confidence"), source.alias("source"), name.alias("name"), F.coalesce(lead != 0, F.lit(False)).alias("decided"))


def unknown_names(texts: DataFrame, registry: DataFrame, id_col: str = "id", text_col: str = "document", common: Iterable[str] = COMMON) -> DataFrame:
    """(id, word): capitalised words of 3 to 16 letters that are neither common nor registered."""
    words = F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]{2,15})(?![\p{L}\p{N}_])"), 1))
    rows = texts.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).where(~is_common(F.col("word"), common)).distinct()
    known = store(called(registry).select("key").distinct(), "names-known")
    return rows.withColumn("key", F.lower("word")).join(small(known), "key", "left_anti").select("id", "word")


def learned(texts: DataFrame, registry: DataFrame, stop: Iterable[str] = (), sure: float = SURE, id_col: str = "id", text_col: str = "document", common: Iterable[str] = COMMON) -> DataFrame:
    """New entries of the registry: capitalised words that a text holds OFTEN or more, that aren't registered, and that the text's own
    signals make a person of confidence ``sure`` or more. The surest text decides."""
    word = F.regexp_extract_all(text_col, F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]{1,19})(?![\p{L}\p{N}_])"), 1)
    counted = texts.select(F.col(id_col).alias("id"), F.explode(word).alias("name")).where(~F.lower("name").isin(*stop) if stop else F.lit(True))
    counted = counted.groupBy("id", "name").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= OFTEN)
    new = counted.join(registry.select("name").distinct(), "name", "left_anti")
    met = new.join(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    counts = P.signals_of(F.col("text"), F.col("name"))
    met = met.select("id", "name", "seen", *(c.alias(k) for k, c in counts.items()))
    kind, confidence = P.classified(F.col("seen"), {k: F.col(k) for k in counts})
    found = met.select("id", "name", kind.alias("kind"), confidence.alias("confidence")).where((F.col("kind") == "person") & (F.col("confidence") >= sure))
    best = found.groupBy("name").agg(F.max("confidence").alias("confidence"))
    none = F.array().cast("array<string>")
    return best.select("name", F.lit("person").alias("kind"), none.alias("aliases"), F.lit("learned").alias("source"), "confidence", F.array(F.lit("personal")).alias("contexts"), F.lit("").alias("relationship"), is_common(F.col("name"), common).alias("ambiguous"))
