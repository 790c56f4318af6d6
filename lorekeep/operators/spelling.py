"""Spelling of users' words, mended by a deletion-neighbourhood index with a cap on edits.

Two strings within d edits have a common string that both reach by deleting d characters at most, and so have their first
``HEAD`` characters. The dictionary is keyed by those deletions of its words' heads (299 keys a word at most), unknown tokens by
theirs; a join on keys finds all candidates, and Spark's banded ``levenshtein`` decides. As the nearest word wins, one edit is
tried first, and more only for tokens that fewer did not mend. Heads are long, so that what is left of one after its
deletions still tells words apart. No text meets the dictionary: only distinct tokens that no rule leaves alone do, and a
text is put together again from its own pieces.

Of words within the cap the nearest wins, then the most frequent, then the first in order. A token keeps its punctuation, blanks stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.engine.shared import drop, sieve, small, store

#: Characters of a word whose deletions are its keys.
HEAD = 12
#: Partitions that the dictionary is dealt over, as each of its words has many keys.
PARTS = 96
#: Rows of a table of words that may be broadcast.
WORDS = 100_000
# Least characters of a token, characters of a short one, and edits that a short and a long one may need.
LEAST, SHORT, FEW, MANY = 4, 7, 2, 3
#: Tokens that are left alone have a digit, a hump, only capitals and signs, a hyphen or underscore, are places, or code.
ALONE = (r"\p{Nd}", r"[A-Z][a-z]+[A-Z]", r"\A[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+\z", r"[-_]", r"(?i)https?://|www\.|/Users/|~/|\.[a-z]{2,4}\z", r"[`*_#{}\[\]\\]")
TAIL = ".,!?;:'\")"
#: Pieces of a text: its tokens and the blanks between them.
PIECES = r"(\s+|\S+)"


def dictionary(texts: DataFrame, least: int = 3, text_col: str = "document") -> DataFrame:
    """(word, times): the lower-case words of ``texts`` that occur so often, of LEAST letters or more."""
    words = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(\p{{Ll}}{{{LEAST},}})(?![\p{{L}}\p{{N}}_])"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= least)


def bare(token: Column) -> Column:
    """A token without punctuation at its end."""
    return F.rtrim(token, F.lit(TAIL))


def left_alone(word: Column) -> Column:
    """Whether the rules leave a bare token as it is: too short, technical, or with a capital in front."""
    rules = [F.length(word) < LEAST, word.rlike(r"\A\p{Lu}"), *(word.rlike(r) for r in ALONE)]
    found = rules[0]
    for rule in rules[1:]:
        found = found | rule
    return found


def cap(word: Column) -> Column:
    return F.when(F.length(word) <= SHORT, FEW).otherwise(MANY)


def _deletions(words: DataFrame, edits: int) -> DataFrame:
    """``words`` with ``key``: a hash of each string that deleting up to ``edits`` characters of the head of ``word`` gives."""
    out = words.withColumn("_head", F.left("word", F.lit(HEAD)))
    out = out.withColumn("_at", F.length("_head") + 1)
    for _ in range(edits):  # one place before the last one, or none: zero
        out = out.withColumn("_at", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_at") - 1, F.lit(0)))))
        less = F.concat(F.substr("_head", F.lit(1), F.col("_at") - 1), F.substr("_head", F.col("_at") + 1))
        out = out.withColumn("_head", F.when(F.col("_at") == 0, F.col("_head")).otherwise(less))
    return out.select(*words.columns, F.xxhash64("_head").alias("key"))


def _met(asked: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``asked`` (word, key) with those of ``index`` (key, ..) that have their key.

    Both have many more keys than words, so that neither may be broadcast, nor looks as large as it is to the optimizer. What a map of
    ``asked``'s keys lets through is shuffled."""
    likely = sieve(index, F.col("key"), asked)
    return likely.hint("merge").join(asked, "key")


def corrections(tokens: DataFrame, words: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(word, correct) for each distinct bare token of ``tokens`` (word) that a word of the dictionary (word, times) is near
    enough to, and that is neither left alone, nor in the dictionary in lower case, nor one of ``names`` (name)."""
    words = store(words.repartition(PARTS), "spelling-words")
    known = words.select(F.col("word").alias("low"))
    if names is not None:
        known = known.unionByName(names.select(F.lower("name").alias("low")))
    unknown = tokens.where(~left_alone(F.col("word"))).select("word").distinct().withColumn("low", F.lower("word"))
    left = store(unknown.join(known.distinct().hint("merge"), "low", "left_anti").select("word"), "spelling-unknown")
    index = words.select(F.col("word").alias("correct"), "times", "word")
    best = F.min_by("correct", F.struct(-F.col("times"), F.col("correct"))).alias("correct")
    found: list[DataFrame] = []
    for edits in range(1, MANY + 1):  # what is left has no word within fewer edits
        asked = store(_deletions(left.where(cap(F.col("word")) >= edits), edits), "spelling-asked")
        met = _met(asked, _deletions(index, edits).drop("word"))
        near = met.where((F.abs(F.length("word") - F.length("correct")) <= edits) & (F.levenshtein("word", "correct", edits) >= 0))
        found.append(store(near.groupBy("word").agg(best), "spelling-near"))
        rest = store(left.join(small(found[-1].select("word"), WORDS), "word", "left_anti"), "spelling-unknown")
        drop(left, asked)
        left = rest
    return reduce(DataFrame.unionByName, found)


def corrected(texts: DataFrame, words: DataFrame, names: DataFrame | None = None, id_col: str = "id", text_col: str = "document") -> DataFrame:
    """``texts`` with mended tokens in ``text_col``. Ids are distinct; null texts stay null."""
    pieces = F.regexp_extract_all(text_col, F.lit(PIECES), 1)
    tokens = texts.select(id_col, F.explode(F.array_distinct(F.transform(pieces, bare))).alias("word")).where(~left_alone(F.col("word")))
    found = small(store(corrections(tokens, words, names), "spelling-found"), WORDS)
    mended = tokens.join(found, "word").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "correct"))).alias("_mend"))
    mended = store(mended, "spelling-mended")
    fix = lambda p: F.coalesce(F.concat(F.try_element_at("_mend", bare(p)), F.substr(p, F.length(bare(p)) + 1)), p)
    whole = F.when(F.col("_mend").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(pieces, fix), ""))
    return texts.join(mended, id_col, "left").withColumn(text_col, whole).drop("_mend")


def corrected_transcripts(transcripts: DataFrame, words: DataFrame, names: DataFrame | None = None, id_col: str = "id", text_col: str = "document") -> DataFrame:
    """The same for the users' lines of transcripts, those that begin with ``>`` after blanks; all others stay as they are."""
    lines = transcripts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("_nth", "_line"))
    quote = F.regexp_extract("_line", r"\A(\s*>.?)[\s\S]*\z", 1)
    said = lines.where(F.col("_line").rlike(r"\A\s*>")).select(F.struct(id_col, "_nth").alias("_at"), quote.alias("_quote"), F.substr("_line", F.length(quote) + 1).alias("_said"))
    said = corrected(said, words, names, "_at", "_said").select("_at", F.concat("_quote", "_said").alias("_line"))
    new = said.groupBy(F.col(f"_at.{id_col}").alias(id_col)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_at._nth"), "_line"))).alias("_lines"))
    put = F.array_join(F.transform(F.split(text_col, "\n"), lambda line, k: F.coalesce(F.try_element_at("_lines", k), line)), "\n")
    return transcripts.join(new, id_col, "left").withColumn(text_col, F.when(F.col("_lines").isNull(), F.col(text_col)).otherwise(put)).drop("_lines")
