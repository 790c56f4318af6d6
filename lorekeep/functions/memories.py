"""Segments of texts, their prose, and the kind of memory that a segment holds."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.noise import strip

# The patterns whose hits are counted, by kind, in the order in which ties are decided.
MARKERS = {
    "decision": (
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b",
        r"\bwe (should|decided|chose|went with|picked|settled on)\b",
        r"\bi'?m going (to|with)\b",
        r"\bbetter (to|than|approach|option|choice)\b",
        r"\binstead of\b",
        r"\brather than\b",
        r"\bthe reason (is|was|being)\b",
        r"\bbecause\b",
        r"\btrade-?off\b",
        r"\bpros and cons\b",
        r"\bover\b.*\bbecause\b",
        r"\barchitecture\b",
        r"\bapproach\b",
        r"\bstrategy\b",
        r"\bpattern\b",
        r"\bstack\b",
        r"\bframework\b",
        r"\binfrastructure\b",
        r"\bset (it |this )?to\b",
        r"\bconfigure\b",
        r"\bdefault\b",
    ),
    "preference": (
        r"\bi prefer\b",
        r"\balways use\b",
        r"\bnever use\b",
        r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b",
        r"\bi like (to|when|how)\b",
        r"\bi hate (when|how|it when)\b",
        r"\bplease (always|never|don'?t)\b",
        r"\bmy (rule|preference|style|convention) is\b",
        r"\bwe (always|never)\b",
        r"\bfunctional\b.*\bstyle\b",
        r"\bimperative\b",
        r"\bsnake_?case\b",
        r"\bcamel_?case\b",
        r"\btabs\b.*\bspaces\b",
        r"\bspaces\b.*\btabs\b",
        r"\buse\b.*\binstead of\b",
    ),
    "milestone": (
        r"\bit works\b",
        r"\bit worked\b",
        r"\bgot it working\b",
        r"\bfixed\b",
        r"\bsolved\b",
        r"\bbreakthrough\b",
        r"\bfigured (it )?out\b",
        r"\bnailed it\b",
        r"\bcracked (it|the)\b",
        r"\bfinally\b",
        r"\bfirst time\b",
        r"\bfirst ever\b",
        r"\bnever (done|been|had) before\b",
        r"\bdiscovered\b",
        r"\brealized\b",
        r"\bfound (out|that)\b",
        r"\bturns out\b",
        r"\bthe key (is|was|insight)\b",
        r"\bthe trick (is|was)\b",
        r"\bnow i (understand|see|get it)\b",
        r"\bbuilt\b",
        r"\bcreated\b",
        r"\bimplemented\b",
        r"\bshipped\b",
        r"\blaunched\b",
        r"\bdeployed\b",
        r"\breleased\b",
        r"\bprototype\b",
        r"\bproof of concept\b",
        r"\bdemo\b",
        r"\bversion \d",
        r"\bv\d+\.\d+",
        r"\d+x (compression|faster|slower|better|improvement|reduction)",
        r"\d+% (reduction|improvement|faster|better|smaller)",
    ),
    "problem": (
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b",
        r"\bdoesn'?t work\b",
        r"\bnot working\b",
        r"\bwon'?t\b.*\bwork\b",
        r"\bkeeps? (failing|crashing|breaking|erroring)\b",
        r"\broot cause\b",
        r"\bthe (problem|issue|bug) (is|was)\b",
        r"\bturns out\b.*\b(was|because|due to)\b",
        r"\bthe fix (is|was)\b",
        r"\bworkaround\b",
        r"\bthat'?s why\b",
        r"\bthe reason it\b",
        r"\bfixed (it |the |by )\b",
        r"\bsolution (is|was)\b",
        r"\bresolved\b",
        r"\bpatched\b",
        r"\bthe answer (is|was)\b",
        r"\b(had|need) to\b.*\binstead\b",
    ),
    "emotional": (
        r"\blove\b",
        r"\bscared\b",
        r"\bafraid\b",
        r"\bproud\b",
        r"\bhurt\b",
        r"\bhappy\b",
        r"\bsad\b",
        r"\bcry\b",
        r"\bcrying\b",
        r"\bmiss\b",
        r"\bsorry\b",
        r"\bgrateful\b",
        r"\bangry\b",
        r"\bworried\b",
        r"\blonely\b",
        r"\bbeautiful\b",
        r"\bamazing\b",
        r"\bwonderful\b",
        r"i feel",
        r"i'm scared",
        r"i love you",
        r"i'm sorry",
        r"i can't",
        r"i wish",
        r"i miss",
        r"i need",
        r"never told anyone",
        r"nobody knows",
        r"\*[^*]+\*",
    ),
}
POSITIVE = "pride proud joy happy love loving beautiful amazing wonderful incredible fantastic brilliant perfect excited thrilled grateful warm breakthrough success works working solved fixed nailed heart hug precious adore".split()
NEGATIVE = "bug error crash crashing crashed fail failed failing failure broken broke breaking breaks issue problem wrong stuck blocked unable impossible missing terrible horrible awful worse worst panic disaster mess".split()
RESOLVED = r"\b(?:fixed|solved|resolved|patched|got it working|it works|nailed it|figured (?:it )?out|the (?:fix|answer|solution))\b"
#: Beginnings of lines (after blanks) that open a speaker's turn, and of lines of code.
TURN = r"[^\S\n]*(?:>[^\S\n]+\S|(?i:human|user|q|assistant|ai|a|claude|chatgpt)[^\S\n]*:)"
CODE = (
    r"\A(?:[$#]\s|(?:cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s|```"
    r"|(?:import|from|def|class|function|const|let|var|return)\s|[A-Z_]{2,}=|\||-{2,}|[{}\[\]]\z|(?:if|for|while|try|except|elif|else:)\b|\w+\.\w+\(|\w+ = \w+\.\w+)"
)
FENCED = r"(?md)^[^\S\n]*```[^\n]*(?:\n|\z)(?:[\s\S]*?^[^\S\n]*```[^\n]*(?:\n|\z)|[\s\S]*)"
#: Lines in a group where a text has no paragraphs.
GROUP = 25


def segments(text: Column, least_turns: int = 3) -> Column:
    """Speakers' turns, if there are ``least_turns``; else paragraphs, or groups of lines of a long single one."""
    turns = F.split(text, rf"\n(?={TURN})")
    full = lambda parts: F.filter(F.transform(parts, strip), lambda p: p != "")
    paragraphs, lines = full(F.split(text, "\n\n")), F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / GROUP).cast("int"))
    groups = full(F.transform(starts, lambda g: F.array_join(F.slice(lines, g * GROUP + 1, F.lit(GROUP)), "\n")))
    single = (F.size(paragraphs) <= 1) & (F.size(lines) > 20)
    return F.when(F.regexp_count(text, F.lit(rf"(?md)^{TURN}")) >= least_turns, turns).when(single, groups).otherwise(paragraphs)


def is_code(bare: Column) -> Column:
    """Whether a line without outer blanks looks like code: by its beginning, or by few letters."""
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", ""))
    return (bare != "") & (bare.rlike(CODE) | ((F.length(bare) > 10) & (letters < 0.4 * F.length(bare))))


def prose(text: Column) -> Column:
    """``text`` without fenced blocks and lines of code; all of it, if nothing else is there."""
    lines = F.transform(F.split(F.regexp_replace(text, FENCED, ""), "\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    kept = strip(F.array_join(F.transform(F.filter(lines, lambda x: ~is_code(x["bare"])), lambda x: x["line"]), "\n"))
    # Mentioned once: inside a lambda, each mention would be evaluated anew.
    return F.coalesce(F.get(F.filter(F.array(kept, text), lambda x: x != ""), F.lit(0)), text)


def needles(pattern: str) -> list[tuple[str, ...]]:
    """What a text must hold for a pattern of MARKERS to hit: of each tuple one. Plain letters and blanks outside groups, and the
    alternatives of groups, are taken; what may be absent is left out."""
    plain = lambda p: max(re.split(r"[a-z '_-]\?|\.\*|\[[^]]*\]\+|\\[bd*.]\+?", p), key=len)
    found = []
    for part in re.split(r"(\([^()]*\)\??)", pattern):
        if part.endswith(")"):
            found.append(tuple(plain(p) for p in part[1:-1].split("|")))
        elif not part.endswith("?"):
            found += [(p,) for p in map(plain, part.split(".*"))]
    return [f for f in found if all(len(x) > 1 for x in f)]


def marker_hits(low: Column, kind: str) -> Column:
    """Hits of a kind's patterns in a lower-case text. A search for plain letters first leaves out most texts, and is many times faster."""
    hits = F.lit(0)
    for m in MARKERS[kind]:
        must = [reduce(or_, (low.contains(x) for x in f)) for f in needles(m)]
        count = F.regexp_count(low, F.lit("(?d)" + m))
        hits = hits + (F.when(~reduce(and_, must), 0).otherwise(count) if must else count)
    return hits


def sentiment(text: Column) -> Column:
    """By distinct words: 'positive', 'negative', or 'neutral' where both kinds are as many."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)
    hits = lambda listed: F.size(F.array_intersect(words, F.array(*map(F.lit, listed))))
    sign = F.signum(hits(POSITIVE) - hits(NEGATIVE)).cast("int")
    return F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), sign + 2)


def memories(documents: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, chunk_index, content, kind, score): the segments of (id, document) that hold a memory.

    The kind has most hits; a solved problem is a milestone, or emotional if it says so. The score is the hits plus one
    for over 200 characters and two for over 500, of which five are certain. Each text becomes one array of segments,
    on which everything else works: no shuffle.
    """
    found = documents.select("id", F.filter(segments(F.col("document")), lambda s: F.length(strip(s)) >= 20).alias("parts"))
    found = found.withColumn("prose", F.transform("parts", prose))
    # Lambdas evaluate what they are given again at each mention: lower-case texts come from a column of their own.
    found = found.withColumn("low", F.transform("prose", F.lower))
    hits = F.transform("low", lambda x: F.struct(*(marker_hits(x, k).alias(k) for k in MARKERS), x.rlike(RESOLVED).alias("solved"), sentiment(x).alias("mood")))
    found = found.select("id", "parts", hits.alias("hits"))

    def judged(part: Column, h: Column) -> Column:
        best = F.greatest(*(h[k] for k in MARKERS))
        first = F.coalesce(*(F.when(h[k] == best, k) for k in MARKERS))
        glad = h["mood"] == "positive"
        kind = (
            F.when(first != "problem", first)
            .when(h["solved"], F.when((h["emotional"] > 0) & glad, "emotional").otherwise("milestone"))
            .when(glad & (h["milestone"] > 0), "milestone")
            .when(glad & (h["emotional"] > 0), "emotional")
            .otherwise(first)
        )
        size = F.length(part)
        score = best + F.when(size > 500, 2).when(size > 200, 1).otherwise(0)
        return F.struct(strip(part).alias("content"), kind.alias("kind"), F.when(best > 0, score).otherwise(0).cast("int").alias("score"))

    kept = F.filter(F.zip_with("parts", "hits", judged), lambda m: (m["score"] > 0) & (m["score"] / 5 >= least))
    # Not ``posexplode``: from that, Catalyst infers a filter that evaluates all of this twice more.
    out = found.select("id", F.posexplode_outer(kept).alias("chunk_index", "m")).where("m IS NOT NULL")
    return out.select("id", "chunk_index", "m.content", "m.kind", "m.score")
