"""Whether a name is a person's or a project's, by what a text says around it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns around a name (@) and their weights.
DIALOGUE = (r"^>\s*@[:\s]", r"^@:\s", r"^\[@\]", r'"@\s+said')
ACTIONS = (r"\b@\s+said\b", r"\b@\s+asked\b", r"\b@\s+told\b", r"\b@\s+replied\b", r"\b@\s+laughed\b", r"\b@\s+smiled\b", r"\b@\s+cried\b", r"\b@\s+felt\b", r"\b@\s+thinks?\b", r"\b@\s+wants?\b", r"\b@\s+loves?\b", r"\b@\s+hates?\b", r"\b@\s+knows?\b", r"\b@\s+decided\b", r"\b@\s+pushed\b", r"\b@\s+wrote\b", r"\bhey\s+@\b", r"\bthanks?\s+@\b", r"\bhi\s+@\b", r"\bdear\s+@\b")
PRONOUNS = r"\b(?:she|her|hers|he|him|his|they|them|their)\b"
ADDRESSED = (r"\bhey\s+@\b|\bthanks?\s+@\b|\bhi\s+@\b",)
VERBS = (r"\bbuilding\s+@\b", r"\bbuilt\s+@\b", r"\bship(?:ping|ped)?\s+@\b", r"\blaunch(?:ing|ed)?\s+@\b", r"\bdeploy(?:ing|ed)?\s+@\b", r"\binstall(?:ing|ed)?\s+@\b", r"\bthe\s+@\s+architecture\b", r"\bthe\s+@\s+pipeline\b", r"\bthe\s+@\s+system\b", r"\bthe\s+@\s+repo\b", r"\b@\s+v\d+\b", r"\b@\.py\b", r"\b@-core\b", r"\b@-local\b", r"\bimport\s+@\b", r"\bpip\s+install\s+@\b")
VERSIONED = (r"\b@[-v]\w+",)
CODE = (r"\b@\.(?:py|js|ts|yaml|yml|json|sh)\b",)
PERSON = {"dialogue": (DIALOGUE, 3), "action": (ACTIONS, 2), "addressed": (ADDRESSED, 4)}
PROJECT = {"verbs": (VERBS, 2), "versioned": (VERSIONED, 3), "code": (CODE, 3)}
PRONOUN_WEIGHT = 2


def signals(text: Column, name: str) -> dict[str, Column]:
    """The counts of each kind of signal for a name in a text; a null text is empty. Pronouns count once for each line that
    holds the name, if one stands within two lines of it."""
    return _signals(text, lambda p: F.lit(f"(?dmi){p.replace('@', re.escape(name))}"), F.lit(name.lower()))


def signals_of(text: Column, name: Column) -> dict[str, Column]:
    """The same for a name that each row brings, of letters and blanks only."""
    return _signals(text, lambda p: F.concat(F.lit("(?dmi)"), F.replace(F.lit(p), F.lit("@"), name)), F.lower(name))


def _signals(text: Column, pattern: Callable[[str], Column], low: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    found = {kind: sum((F.regexp_count(text, pattern(p)) for p in patterns), F.lit(0)) for kind, (patterns, _) in (PERSON | PROJECT).items()}
    lines = F.split(F.lower(text), "\n")
    near = lambda i: F.array_join(F.slice(lines, F.greatest(i - 2, F.lit(1)), F.least(i + 2, F.size(lines)) - F.greatest(i - 2, F.lit(1)) + 1), " ")
    places = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.contains(F.get(lines, i - 1), low) & near(i).rlike(PRONOUNS))
    return found | {"pronoun": F.size(places)}


def person_score(counts: dict[str, Column]) -> Column:
    return sum((counts[k] * w for k, (_, w) in PERSON.items()), counts["pronoun"] * PRONOUN_WEIGHT)


def project_score(counts: dict[str, Column]) -> Column:
    return sum((counts[k] * w for k, (_, w) in PROJECT.items()), F.lit(0))


def classified(frequency: Column, counts: dict[str, Column]) -> tuple[Column, Column]:
    """(type, confidence): a person needs seven tenths of the score, five points, and two kinds of signals. Only the first
    three kinds that occur count, in the order dialogue, action, pronoun, addressed, so that two are always seen."""
    person, project = person_score(counts), project_score(counts)
    total = person + project
    share = person / F.when(total > 0, total)
    kinds = sum(((counts[k] > 0).cast("int") for k in ("dialogue", "action", "pronoun", "addressed")), F.lit(0))
    sure = (share >= 0.7) & (kinds >= 2) & (person >= 5)
    kind = F.when(sure, "person").when((total > 0) & (share <= 0.3), "project").otherwise("uncertain")
    confidence = (
        F.when(total == 0, F.least(F.lit(0.4), frequency / 50))
        .when(sure, F.least(F.lit(0.99), 0.5 + share * 0.5))
        .when(share >= 0.7, F.lit(0.4))
        .when(share <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - share) * 0.5))
        .otherwise(F.lit(0.5))
    )
    return kind, F.round(confidence, 2)
