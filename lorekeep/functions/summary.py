"""Compact one-line summaries of texts: names, topics, a key sentence, moods and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.noise import strip
from lorekeep.functions.once import once

# Signals in texts, with the codes they stand for, and words that are no topics.
MOODS = {
    "decided": "determ",
    "prefer": "convict",
    "worried": "anx",
    "excited": "excite",
    "frustrated": "frust",
    "confused": "confuse",
    "love": "love",
    "hate": "rage",
    "hope": "hope",
    "fear": "fear",
    "trust": "trust",
    "happy": "joy",
    "sad": "grief",
    "surprised": "surprise",
    "grateful": "grat",
    "curious": "curious",
    "wonder": "wonder",
    "anxious": "anx",
    "relieved": "relief",
    "satisf": "satis",
    "disappoint": "grief",
    "concern": "anx",
}
FLAGS = {
    "decided": "DECISION",
    "chose": "DECISION",
    "switched": "DECISION",
    "migrated": "DECISION",
    "replaced": "DECISION",
    "instead of": "DECISION",
    "because": "DECISION",
    "founded": "ORIGIN",
    "created": "ORIGIN",
    "started": "ORIGIN",
    "born": "ORIGIN",
    "launched": "ORIGIN",
    "first time": "ORIGIN",
    "core": "CORE",
    "fundamental": "CORE",
    "essential": "CORE",
    "principle": "CORE",
    "belief": "CORE",
    "always": "CORE",
    "never forget": "CORE",
    "turning point": "PIVOT",
    "changed everything": "PIVOT",
    "realized": "PIVOT",
    "breakthrough": "PIVOT",
    "epiphany": "PIVOT",
    "api": "TECHNICAL",
    "database": "TECHNICAL",
    "architecture": "TECHNICAL",
    "deploy": "TECHNICAL",
    "infrastructure": "TECHNICAL",
    "algorithm": "TECHNICAL",
    "framework": "TECHNICAL",
    "server": "TECHNICAL",
    "config": "TECHNICAL",
}
STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on "
    "with at by from as into about between through during before after above below up down out off over under again further then "
    "once here there when where why how all each every both few more most other some such no nor not only own same so than too "
    "very just don now and but or if while that this these those it its i we you he she they me him her us them my your his our "
    "their what which who whom also much many like because since get got use used using make made thing things way well really "
    "want need"
).split()
DECISIVE = "decided because instead prefer switched chose realized important key critical discovered learned conclusion solution reason why breakthrough insight".split()


def signals(text: Column, codes: dict[str, str], most: int = 3) -> Column:
    """The first distinct codes whose signals are in ``text``, in the order of ``codes``."""
    found = once(F.lower(text), lambda low: F.array(*(F.when(low.contains(signal), code) for signal, code in codes.items())))
    return F.slice(F.array_distinct(F.array_compact(found)), 1, most)


def topics(text: Column, most: int = 3) -> Column:
    """The heaviest words: one for each use, two more for a capital, two more for inner capitals or ``_`` and ``-``.

    Words are sorted and added up in one pass that keeps the best ``most``: no shuffle, and no comparison of all words.
    """
    words = F.regexp_extract_all(text, F.lit(r"([a-zA-Z][a-zA-Z_-]{2,})"), 1)
    weight = lambda w: F.lit(1) + F.when(w.rlike("^[A-Z]"), 2).otherwise(0) + F.when(w.rlike("[_-]|^.+[A-Z]"), 2).otherwise(0)
    used = F.filter(F.transform(words, lambda w, k: F.struct(F.lower(w).alias("word"), k.alias("at"), weight(w).alias("weight"))), lambda u: ~u["word"].isin(STOP))
    none = F.array().cast("array<struct<weight:int,at:int,word:string>>")
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("at"), F.lit(0).alias("weight"), none.alias("best"))
    entry = lambda a: F.array(F.struct((-a["weight"]).alias("weight"), a["at"].alias("at"), a["word"].alias("word")))
    settled = lambda a: F.when(a["word"] == "", a["best"]).otherwise(F.slice(F.array_sort(F.concat(a["best"], entry(a))), 1, most))

    def add(a: Column, u: Column) -> Column:
        same = a["word"] == u["word"]
        return F.struct(
            u["word"].alias("word"),
            F.when(same, a["at"]).otherwise(u["at"]).alias("at"),
            (u["weight"] + F.when(same, a["weight"]).otherwise(0)).alias("weight"),
            F.when(same, a["best"]).otherwise(settled(a)).alias("best"),
        )

    return F.transform(F.aggregate(F.sort_array(used), start, add, settled), lambda t: t["word"])


def key_sentence(text: Column, most: int = 55) -> Column:
    """The sentence with the most decisive words, short ones first; null without a sentence of over ten characters."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?\n]+"), strip), lambda s: F.length(s) > 10)

    def score(s: Column, low: Column) -> Column:
        n = F.length(s)
        hits = sum((F.when(low.contains(w), 2).otherwise(0) for w in DECISIVE), F.lit(0))
        return hits + F.when(n < 80, 1).otherwise(0) + F.when(n < 40, 1).otherwise(0) - F.when(n > 150, 2).otherwise(0)

    def first(found: Column) -> Column:
        scores = F.zip_with(found, F.transform(found, F.lower), score)
        return once(scores, lambda s: F.when(F.size(found) > 0, F.get(found, F.array_position(s, F.array_max(s)).cast("int") - 1)))

    shown = lambda best: F.when(F.length(best) > most, F.concat(F.substring(best, 1, most - 3), F.lit("..."))).otherwise(best)
    return once(once(sentences, first), shown)


def name_codes(text: Column, known: dict[str, str] | None = None, most: int = 3) -> Column:
    """Codes of known names; without one, the first letters of capitalised words that don't begin the text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    later = once(words, lambda ws: F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))))
    bare = F.transform(later, lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    names = F.filter(bare, lambda w: w.rlike("^[A-Z][a-z]+$") & ~F.lower(w).isin(STOP))
    guessed = F.array_distinct(F.transform(names, lambda w: F.upper(F.substring(w, 1, 3))))
    if not known:
        return F.slice(guessed, 1, most)
    low = F.lower(text)
    found = F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(n.lower()), c) for n, c in known.items() if not n.islower()))))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(guessed), 1, most)


def _or(parts: Column, sep: str, otherwise: str | None) -> Column:
    return once(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, sep)).otherwise(F.lit(otherwise)))


def compact(text: Column, known: dict[str, str] | None = None) -> Column:
    """``0:names|topics|"key sentence"|moods|flags``; parts without content are left out. A null text gives null."""
    quote = key_sentence(text)
    line = F.concat_ws("|", F.concat(F.lit("0:"), _or(name_codes(text, known), "+", "???")), _or(topics(text), "_", "misc"), F.concat(F.lit('"'), quote, F.lit('"')), _or(signals(text, MOODS), "+", None), _or(signals(text, FLAGS), "+", None))
    return F.when(text.isNotNull(), line)


def header(domain: Column, topic: Column, date: Column, source_file: Column) -> Column:
    """``domain|topic|date|stem``, with a question mark for what isn't known."""
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    stem = F.regexp_replace(F.regexp_replace(source_file, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("|", *map(shown, (domain, topic, date, stem)))


def token_estimate(text: Column) -> Column:
    """1.3 tokens for each word, one at least."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * 13 / 10).cast("int"))
