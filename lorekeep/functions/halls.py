"""Halls: the kind of memory that a session holds, or that a question asks for, by the signals in its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The halls, and the signals that lead to each.
PREFERENCES, ADVICE, EVENTS, FACTS, GENERAL = "hall_preferences", "hall_assistant_advice", "hall_events", "hall_facts", "hall_general"
SAYS_PREFERENCE = ("i prefer", "i usually", "i've been having trouble", "i've been feeling", "i've been struggling", "i want to", "i'm worried", "i've been thinking", "i've been considering", "lately i", "recently i", "i tend to")
SAYS_ADVICE = ("i suggest", "i recommend", "here are", "you might want to", "option 1", "option 2", "1.", "2.", "3.", "first,", "second,", "you could try", "i would recommend", "my recommendation")
SAYS_EVENT = ("milestone", "graduation", "promotion", "anniversary", "birthday", "moved", "started", "finished", "completed", "launched", "opened", "achieved", "won", "accepted", "hired", "married", "born")
SAYS_FACT = ("degree", "major", "university", "college", "job", "position", "role", "company", "city", "country", "street", "born in", "grew up", "studied", "works at", "lives in", "years old", "salary", "budget")
ASKS_ADVICE = ("you suggested", "you told me", "you mentioned", "you said", "you recommended", "you provided", "you listed", "you gave", "remind me what you", "you came up with", "you explained")
ASKS_PREFERENCE = ("i've been having trouble", "i've been feeling", "i prefer", "i usually", "battery", "nostalgic", "reunion", "lately", "recently been", "struggling with")
ASKS_EVENT = ("milestone", "when did", "what happened", "achievement", "ago", "last week", "last month", "last year", "four weeks", "three months")
ASKS_FACT = ("degree", "study", "graduate", "major", "job", "work", "live", "born", "city", "country", "company", "school")


def hits(text: Column, signals: tuple[str, ...]) -> Column:
    """How many of the signals occur in a text of lower case."""
    return sum((text.contains(s).cast("int") for s in signals), F.lit(0))


def session_hall(user: Column, assistant: Column) -> Column:
    """The hall of a session, from all that each side said in lower case. One preference of the user's is enough, advice
    and facts need two signals."""
    both = F.concat(user, assistant)
    return (
        F.when(hits(user, SAYS_PREFERENCE) > 0, PREFERENCES)
        .when(hits(assistant, SAYS_ADVICE) > 1, ADVICE)
        .when(hits(both, SAYS_EVENT) > 0, EVENTS)
        .when(hits(both, SAYS_FACT) > 1, FACTS)
        .otherwise(GENERAL)
    )


def question_halls(question: Column) -> Column:
    """The halls that a question asks for, likeliest first. A null question is empty."""
    q = F.lower(F.coalesce(question, F.lit("")))
    halls = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(hits(q, ASKS_ADVICE) > 0, halls(ADVICE, GENERAL))
        .when(hits(q, ASKS_PREFERENCE) > 0, halls(PREFERENCES, GENERAL))
        .when(hits(q, ASKS_EVENT) > 0, halls(EVENTS, FACTS, GENERAL))
        .when(hits(q, ASKS_FACT) > 0, halls(FACTS, GENERAL))
        .otherwise(halls(GENERAL))
    )


def sessions(turns: DataFrame) -> DataFrame:
    """(conv_id, hall) of turns (conv_id, turn, role, text). Signals may run over the border of two turns, so a session's
    texts are joined in order; null texts are left out."""

    def said(role: str) -> Column:
        texts = F.array_sort(F.collect_list(F.when((F.col("role") == role) & F.col("text").isNotNull(), F.struct("turn", "text"))))
        return F.lower(F.array_join(F.transform(texts, lambda t: t["text"]), " "))

    joined = turns.groupBy("conv_id").agg(said("user").alias("u"), said("assistant").alias("a"))
    return joined.select("conv_id", session_hall(F.col("u"), F.col("a")).alias("hall"))
