"""Facts found in texts by rules, and proposed facts on their way to being accepted or rejected.

A proposal has the columns of ``COLUMNS``. As with other tables, each operator returns the next version of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.facts import add, entity_id, normal_predicate

# Tokens, sentence ends, words of modality, subjects that stand for the source, rules with their confidence, and
# predicates of which a subject has one object at a time.
ENTITY = r"[A-Za-z][A-Za-z0-9_.-]*"
SUBJECT = r"[A-Z][A-Za-z0-9_.-]*"
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"
HYPOTHETICAL = ("maybe", "might", "could", "should", "someday", "consider", "thinking about")
PLANNED = ("plan to", "going to", "will ")
SELF = ("we", "it", "system", "project")
SELF_PATTERN = "(?:we|it|system|project)"
UNSURE = 0.58
EXCLUSIVE = ("uses", "migrated_to", "deployed_to", "owned_by", "replaced_by", "superseded_by")
#: (pattern, ((predicate, group of the object), ...), group of the subject or 0 for the source, confidence if asserted, else).
RULES = (
    (rf"(?iU)\bswitched from\s+({ENTITY})\s+to\s+({ENTITY})\b", (("migrated_from", 1), ("migrated_to", 2)), 0, 0.9, 0.9),
    (rf"(?iU)\bmigrated from\s+({ENTITY})\s+to\s+({ENTITY})\b", (("migrated_from", 1), ("migrated_to", 2)), 0, 0.9, 0.9),
    (rf"(?iU)\breplaced\s+({ENTITY})\s+with\s+({ENTITY})\b", (("migrated_from", 1), ("migrated_to", 2)), 0, 0.88, 0.88),
    (rf"(?U)\b({SUBJECT})\s+uses\s+({ENTITY})\b", (("uses", 2),), 1, 0.84, UNSURE),
    (rf"(?iU)\b({SUBJECT})\s+depends on\s+({ENTITY})\b", (("depends_on", 2),), 1, 0.84, UNSURE),
    (rf"(?iU)\b({SUBJECT})\s+built with\s+({ENTITY})\b", (("uses", 2),), 1, 0.84, UNSURE),
    (rf"(?iU)\b({SUBJECT})\s+deployed to\s+({ENTITY})\b", (("deployed_to", 2),), 1, 0.84, UNSURE),
    (rf"(?iU)\b{SELF_PATTERN}\s+use\s+({ENTITY})\b", (("uses", 1),), 0, 0.8, UNSURE),
    (rf"(?iU)\b{SELF_PATTERN}\s+depends on\s+({ENTITY})\b", (("depends_on", 1),), 0, 0.8, UNSURE),
    (rf"(?iU)\b{SELF_PATTERN}\s+built with\s+({ENTITY})\b", (("uses", 1),), 0, 0.76, UNSURE),
    (rf"(?iU)\b{SELF_PATTERN}\s+deployed to\s+({ENTITY})\b", (("deployed_to", 1),), 0, 0.82, UNSURE),
    (rf"(?U)\b({SUBJECT})\s+works on\s+({SUBJECT})\b", (("works_on", 2),), 1, 0.84, UNSURE),
    (rf"(?U)\b({SUBJECT})\s+maintains\s+({SUBJECT})\b", (("maintains", 2),), 1, 0.82, UNSURE),
)
#: For hypothetical sentences alone.
TRY = (rf"(?iU)\b(?:try|use)\s+({ENTITY})\b", (("uses", 1),), 0, 0.55, 0.55)
#: A sentence that any rule fits has one of these.
HINT = r"(?i)from|with|uses?\s|\son\s|deployed|maintains|try"

#: Partitions of records and of what they say.
PARTS = 192

COLUMNS = ("candidate_id", "subject", "predicate", "object", "confidence", "modality", "polarity", "valid_from", "valid_to", "source_id", "evidence", "source_file", "domain", "topic", "status", "reviewed_at")


def modality(sentence: Column) -> Column:
    low = F.lower(sentence)
    has = lambda words: F.greatest(F.lit(False), *(low.contains(w) for w in words))
    return F.when(low.contains("?"), "question").when(has(HYPOTHETICAL), "hypothetical").when(has(PLANNED), "planned").otherwise("asserted")


def _found(s: Column, mode: Column, source: Column, rule: tuple, place: int, only: Column | None = None) -> list[Column]:
    pattern, objects, by, sure, unsure = rule
    subject = F.regexp_extract(s, pattern, by) if by else source
    fits = s.rlike(pattern) if only is None else only & s.rlike(pattern)
    if by and len(objects) == 1 and objects[0][0] not in ("works_on", "maintains"):
        fits = fits & ~F.lower(subject).isin(*SELF)
    confidence = F.when(mode == "asserted", F.lit(sure)).otherwise(F.lit(unsure))
    return [
        F.when(fits, F.struct(F.lit(2 * place + k).alias("place"), subject.alias("subject"), F.lit(name).alias("predicate"), F.regexp_extract(s, pattern, g).alias("object"), confidence.alias("confidence")))
        for k, (name, g) in enumerate(objects)
    ]


def digest(*parts: Column) -> Column:
    """Sixteen digits of the hash of the parts, joined by NUL; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def extract(records: DataFrame, version: str = "rules-v1") -> DataFrame:
    """Candidate facts of (id, document, domain, topic, source_file), one row for each (id, preview_id).

    Sentences that ask are left out. A source that speaks of itself is its domain, else its file, else 'project'. Of equal
    candidates of one text the last counts. Null and empty texts give none.
    """
    source = F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.nullif(F.col("source_file"), F.lit("")), F.lit("project"))
    kept = ("id", "domain", "topic", "source_file")
    # A small file can hold many records: dealt anew, so that no task has the facts of them all.
    sentences = records.repartition(PARTS, "id").select(*kept, source.alias("source"), F.posexplode(F.split("document", SENTENCE_END)).alias("nth", "s"))
    sentences = sentences.where(F.col("s").rlike(HINT)).withColumn("s", F.trim(F.regexp_replace("s", r"(?U)^\s+|\s+$", ""))).withColumn("modality", modality(F.col("s")))
    s, mode = F.col("s"), F.col("modality")
    rows = []
    for place, rule in enumerate(RULES):
        # Of the two ways to say from and to, the first that fits counts.
        only = ~s.rlike(RULES[0][0]) if place == 1 else None
        rows += _found(s, mode, F.col("source"), rule, place, only)
    rows += _found(s, mode, F.col("source"), TRY, len(RULES), mode == "hypothetical")
    facts = sentences.where(mode != "question").select(*kept, "nth", "modality", F.col("s").alias("evidence"), F.explode(F.array_compact(F.array(*rows))).alias("f"))
    facts = facts.select(*kept, "nth", "f.place", "f.subject", "f.predicate", "f.object", "f.confidence", "modality", "evidence")
    facts = facts.withColumn("preview_id", F.concat(F.lit("preview_"), digest(*map(F.col, ("predicate", "subject", "object", "id")))))
    last = facts.groupBy("id", "preview_id").agg(F.max_by(F.struct(*(c for c in facts.columns if c not in ("id", "preview_id"))), F.struct("nth", "place")).alias("f"))
    return last.select("id", "preview_id", "f.*").drop("nth", "place").withColumn("version", F.lit(version))


def propose(candidates: DataFrame) -> DataFrame:
    """What ``extract`` found, as proposals: the id is a digest of all that a proposal says and of where it comes from."""
    out = candidates.withColumnsRenamed({"id": "source_id"}).withColumn("polarity", F.lit("positive"))
    for empty in ("valid_from", "valid_to", "reviewed_at"):
        out = out.withColumn(empty, F.lit(None).cast("string"))
    said = ("subject", "predicate", "object", "modality", "polarity", "valid_from", "valid_to", "source_id", "evidence", "source_file", "domain", "topic")
    return out.withColumn("candidate_id", F.concat(F.lit("cand_"), digest(*map(F.col, said)))).withColumn("status", F.lit("proposed")).select(*COLUMNS)


def merge(proposals: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` over ``proposals`` by id; one that is there keeps its status and when it was reviewed. Neither is broadcast: from small files
    many proposals come."""
    state = proposals.select("candidate_id", F.col("status").alias("old_status"), F.col("reviewed_at").alias("old_at"))
    fresh = new.dropDuplicates(["candidate_id"]).join(state.hint("merge"), "candidate_id", "left")
    fresh = fresh.withColumn("status", F.coalesce("old_status", "status")).withColumn("reviewed_at", F.when(F.col("old_status").isNotNull(), F.col("old_at")).otherwise(F.col("reviewed_at")))
    return proposals.join(new.select("candidate_id").hint("merge"), "candidate_id", "left_anti").unionByName(fresh.drop("old_status", "old_at"))


def page(proposals: DataFrame, match: Column | None = None, least: float | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Proposals under a predicate and of at least a confidence, by (text, id)."""
    out = proposals if match is None else proposals.where(match)
    out = out if least is None else out.where(F.col("confidence") >= least)
    return out.orderBy("source_id", "candidate_id").offset(offset).limit(limit)


def with_conflicts(proposals: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds the other objects that open facts hold, sorted, for asserted positive proposals of an exclusive predicate."""
    held = facts.where(F.col("valid_to").isNull() & F.col("predicate").isin(*EXCLUSIVE))
    held = held.groupBy(entity_id(F.col("subject")).alias("key"), F.col("predicate").alias("held_predicate")).agg(F.sort_array(F.collect_set("object")).alias("held"))
    strict = (F.col("modality") == "asserted") & (F.col("polarity") == "positive") & F.col("predicate").isin(*EXCLUSIVE)
    joined = proposals.join(held, strict & (entity_id(F.col("subject")) == F.col("key")) & (F.col("predicate") == F.col("held_predicate")), "left")
    other = F.filter(F.coalesce("held", F.array().cast("array<string>")), lambda o: o != F.col("object"))
    return joined.withColumn("conflicting", other).drop("key", "held_predicate", "held")


def set_status(proposals: DataFrame, chosen: Column, status: str, at: str) -> DataFrame:
    """Gives the chosen ones that are still proposed a status; others keep theirs."""
    hit = chosen & (F.col("status") == "proposed")
    return proposals.withColumns({"reviewed_at": F.when(hit, F.lit(at)).otherwise(F.col("reviewed_at")), "status": F.when(hit, F.lit(status)).otherwise(F.col("status"))})


def reject(proposals: DataFrame, chosen: Column, at: str) -> DataFrame:
    return set_status(proposals, chosen, "rejected", at)


def accept(proposals: DataFrame, facts: DataFrame, chosen: Column, at: str, close_conflicts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(proposals, facts): the chosen ones that are still proposed become facts from their start, or from ``at``, on.

    A fact that is open already isn't added again. With ``close_conflicts``, open facts of an exclusive predicate that say
    something else of an accepted asserted proposal's subject end at ``at``.
    """
    taken = proposals.where(chosen & (F.col("status") == "proposed"))
    columns = ["subject", "predicate", "object", "valid_from", "valid_to"]
    new = taken.select("subject", normal_predicate(F.col("predicate")).alias("predicate"), "object", F.coalesce("valid_from", F.lit(at)).alias("valid_from"), "valid_to")
    held = facts.select(*columns)
    if close_conflicts:
        strict = taken.where((F.col("modality") == "asserted") & (F.col("polarity") == "positive") & F.col("predicate").isin(*EXCLUSIVE))
        said = strict.groupBy(entity_id(F.col("subject")).alias("key"), F.col("predicate").alias("said_predicate")).agg(F.collect_set("object").alias("said"))
        joined = held.join(said, (entity_id(held["subject"]) == said["key"]) & (held["predicate"] == said["said_predicate"]), "left")
        ends = F.col("valid_to").isNull() & F.col("said").isNotNull() & ~F.coalesce(F.array_contains("said", F.col("object")), F.lit(False))
        held = joined.withColumn("valid_to", F.when(ends, F.lit(at)).otherwise(F.col("valid_to"))).select(*columns)
    return set_status(proposals, chosen, "accepted", at), held.unionByName(add(held, new).select(*columns))
