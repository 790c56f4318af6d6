"""Texts cut into overlapping chunks at natural breaks, and transcripts cut into exchanges."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.noise import strip

#: Kinds of breaks from the best to the least, each with how many characters behind it have to lie before the cut.
BREAKS = ((re.compile(r"(?=\n\n)"), 2), (re.compile(r"\n"), 1), (re.compile(r"(?<=[.!?])(?=\s)"), 0), (re.compile(r"[ \t]"), 1))
WORDS = re.compile(r"(?<=\s)\S")


class Places(list):
    """Ascending positions."""

    def upto(self, high: int, low: int) -> int | None:
        """The last one from ``low`` to ``high``."""
        k = bisect_right(self, high)
        return self[k - 1] if k and self[k - 1] >= low else None

    def since(self, low: int, default: int) -> int:
        k = bisect_left(self, low)
        return self[k] if k < len(self) else default


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The chunks' places in a text. All breaks are found in one pass for each kind, so a window only looks them up."""
    kinds = [(Places(m.start() for m in kind.finditer(text)), behind) for kind, behind in BREAKS]
    words, start = Places(m.start() for m in WORDS.finditer(text)), 0
    while len(text) - start > size:
        low, high = start + size // 2, start + size
        # A sentence may end with the window, whatever follows.
        ends = [high if behind == 0 and text[high - 1] in ".!?" else at.upto(high - behind, low) for at, behind in kinds]
        stop = next((e for e in ends if e is not None), high)
        yield start, stop
        back = stop - overlap
        word = back if text[back - 1].isspace() else words.since(back + 1, len(text))
        # A word that goes on behind the cut is taken up where the overlap begins: none of it may be lost.
        start = word if word <= stop or text[stop:word].isspace() else back
    if start < len(text):
        yield start, len(text)


def cut(text: str, size: int = 800, overlap: int = 100, least: int = 50) -> list[str]:
    """Chunks of at most ``size`` characters.

    A chunk ends at the last break of the best kind in the second half of its window; the next begins ``overlap`` characters
    earlier (under half of ``size``, so that chunks move on), put off to the start of a word, unless that would skip a part of
    the text. A text under ``least`` characters gives none; of others every character that isn't blank is in a chunk: a chunk
    under ``least`` begins earlier, as far as it has to and the text goes, or is left out if the one before holds all of it.
    """
    if size < 2 or not 0 <= overlap < size // 2:
        raise ValueError(f"chunks of {size} characters can't overlap by {overlap}")
    text = text.strip()
    out: list[str] = []
    if len(text) < least:
        return out
    done = 0
    for a, b in spans(text, size, overlap):
        if len(text[a:b].strip()) < least:
            if not text[max(a, done) : b].strip():
                continue
            # Blanks at the end don't count, so what is missing lies before the last character that isn't blank.
            a = max(min(a, len(text[:b].rstrip()) - least), 0)
            while a and text[a].isspace():
                a -= 1
        out.append(text[a:b].strip())
        done = b
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda t: cut(t) if t is not None else None)


def chunks(documents: DataFrame) -> DataFrame:
    """(id, chunk_index, content) of (id, document). Where a chunk ends decides where the next begins: Python walks a text."""
    return documents.select("id", F.posexplode(pieces("document")).alias("chunk_index", "content"))


def exchange_units(text: Column, size: int = 800, least: int = 30) -> Column:
    """Slices of a transcript's exchanges: each quoted line with all up to the next, or up to a line of dashes.

    Without three quoted lines, paragraphs are sliced, or groups of 25 lines of a long single one. Units of ``least``
    characters or fewer go; of others nothing is lost.
    """
    lines = F.split(text, "\n")
    opens = lambda x: strip(x).startswith(">")
    parts = F.split(text, r"\n(?=[^\S\n]*(?:>|---))")
    units = F.transform(F.filter(parts, opens), lambda u: F.concat(strip(F.regexp_extract(u, r"\A([^\n]*)", 1)), F.regexp_replace(F.regexp_extract(u, r"\A[^\n]*((?:\n[\s\S]*)?)\z", 1), r"\n+\z", "")))
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 25).cast("int"))
    groups = F.transform(starts, lambda g: strip(F.array_join(F.slice(lines, g * 25 + 1, F.lit(25)), "\n")))
    single = (F.size(paragraphs) <= 1) & (F.size(lines) > 21)
    found = F.when(F.size(F.filter(lines, opens)) >= 3, units).when(single, groups).otherwise(paragraphs)
    kept = F.filter(found, lambda u: F.length(strip(u)) > least)
    slices = lambda u: F.transform(F.sequence(F.lit(0), F.floor((F.length(u) - 1) / size).cast("int")), lambda k: F.substr(u, k * size + 1, F.lit(size)))
    return F.flatten(F.transform(kept, slices))
