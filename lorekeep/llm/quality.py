"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule needs a few features of a text and rejects by a predicate on them. A sample by a hash of the texts, taken
over all files and bounded by ``sample_rows``, gives every rule's rejection rate and the CPU time that it adds to
the features which are computed anyway; the cascade runs the rules in the order of rejection per cost and
computes the features of a rule only for rows that no earlier rule rejected (the features stand under a CASE
that Spark evaluates lazily). The order is logged. It changes the work, never the verdict: a row is kept exactly if no rule
rejects it.

Defined results: a null text counts as empty; an empty text has no words and fails ``few_words``; repeated
rows and ties get the same verdict each; an empty table gives an empty table. Columns of the input pass
through unchanged under any name; only in ``quality_report`` one that is named like a figure (see ``REPORT``) gives way to it.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import runtime
from lorekeep.llm import text as T

LOG = logging.getLogger(__name__)
P = "__q_"
#: All columns of the input, as one that no feature can clash with.
GIVEN = P + "given"
#: Rows of the sample, at most about.
SAMPLE_ROWS = 1000
#: Runs of each measurement, of which the least counts.
RUNS = 2
TEXT = P + "text"
#: Words of a window, in the rule about repeats.
WINDOW = 8


def _c(name: str) -> Column:
    return F.col(P + name)


# Features: each adds columns, computed only where ``alive`` holds. A column that later ones read more than once
# is a step of its own, which keeps Catalyst from copying its expression into each reader.


def _words(df: DataFrame, alive: Column) -> DataFrame:
    df = df.withColumn(P + "words", F.when(alive, T.words(F.col(TEXT))))
    return df.withColumn(P + "n_words", F.size(_c("words")).cast("long"))


def _word_chars(df: DataFrame, alive: Column) -> DataFrame:
    return df.withColumn(P + "word_chars", F.when(alive, F.length(F.array_join(_c("words"), "")).cast("long")))


def _symbols(df: DataFrame, alive: Column) -> DataFrame:
    rest = F.regexp_replace(F.col(TEXT), r"[#*$%&|<>]+", "")
    return df.withColumn(P + "n_symbols", F.when(alive, (F.length(TEXT) - F.length(rest)).cast("long")))


def _lines(df: DataFrame, alive: Column) -> DataFrame:
    lines = F.filter(F.split(F.col(TEXT), "\n", -1), lambda x: x.rlike(T.WORD))
    df = df.withColumn(P + "lines", F.when(alive, lines))
    df = df.withColumn(P + "n_lines", F.size(_c("lines")).cast("long"))
    return df.withColumn(P + "n_dup_lines", (_c("n_lines") - F.size(F.array_distinct(_c("lines")))).cast("long")).drop(P + "lines")


def _repeats(df: DataFrame, alive: Column) -> DataFrame:
    """Words in windows that occur twice or more: equal window hashes are found by sorting (hash, place), and
    each such place covers ``WINDOW`` words, or as many as there are up to the next."""
    df = df.withColumn(P + "hash", F.when(alive, F.transform(_c("words"), lambda w: F.xxhash64(w))))
    last = F.size(_c("hash")) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(_c("hash"), i + k) for k in range(WINDOW))))
    df = df.withColumn(P + "windows", F.when(alive & (last >= 0), windows))
    some = F.size(F.array_distinct(_c("windows"))) < F.size(_c("windows"))
    order = F.sort_array(F.transform(_c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(P + "order", F.when(_c("windows").isNotNull() & some, order))
    same = lambda x, k: F.coalesce(F.get(_c("order"), k)["h"] == x["h"], F.lit(False))
    twice = F.filter(_c("order"), lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn(P + "places", F.when(_c("order").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    gaps = F.transform(_c("places"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(_c("places"), k + 1), p + WINDOW) - p))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")
    df = df.withColumn(P + "n_repeat_words", F.when(alive, F.when(_c("places").isNotNull(), covered).otherwise(F.lit(0).cast("long"))))
    return df.drop(P + "hash", P + "windows", P + "order", P + "places")


def _capitals(df: DataFrame, alive: Column) -> DataFrame:
    count = lambda rest: F.length(F.regexp_replace(F.col(TEXT), rest, "")).cast("long")
    df = df.withColumn(P + "n_letters", F.when(alive, count(r"\P{L}+")))
    return df.withColumn(P + "n_capitals", F.when(alive, count(r"\P{Lu}+")))


def _stutter(df: DataFrame, alive: Column) -> DataFrame:
    again = F.filter(F.sequence(F.lit(1), F.size(_c("words")) - 1), lambda i: F.get(_c("words"), i) == F.get(_c("words"), i - 1))
    n = F.when(F.size(_c("words")) > 1, F.size(again)).otherwise(0).cast("long")
    return df.withColumn(P + "n_stutter", F.when(alive, n))


#: Feature group -> (how to add it, the groups that it reads).
FEATURES: dict[str, tuple[Callable[[DataFrame, Column], DataFrame], tuple[str, ...]]] = {
    "words": (_words, ()),
    "word_chars": (_word_chars, ("words",)),
    "symbols": (_symbols, ()),
    "lines": (_lines, ()),
    "repeats": (_repeats, ("words",)),
    "capitals": (_capitals, ()),
    "stutter": (_stutter, ("words",)),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text by ``rejects``, which reads the columns of the feature groups ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


@dataclass(frozen=True)
class RuleStats:
    rule: Rule
    rejection: float
    seconds: float

    @property
    def worth(self) -> float:
        return self.rejection / max(self.seconds, 1e-3)


FEW_WORDS = Rule("few_words", ("words",), lambda: _c("n_words") < 20)
REPEATS = Rule("repeats", ("words", "repeats"), lambda: 100 * _c("n_repeat_words") > 30 * _c("n_words"))
#: The contract's base rules.
BASE_RULES: tuple[Rule, ...] = (FEW_WORDS, REPEATS)
#: The method's own rules.
RULES: tuple[Rule, ...] = (
    Rule("symbols", ("words", "symbols"), lambda: 100 * _c("n_symbols") > 10 * _c("n_words")),
    Rule("dup_lines", ("lines",), lambda: 100 * _c("n_dup_lines") > 50 * _c("n_lines")),
    Rule("word_length", ("words", "word_chars"), lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 15 * _c("n_words"))),
    Rule("capitals", ("capitals",), lambda: 100 * _c("n_capitals") > 50 * _c("n_letters")),
    Rule("stutter", ("words", "stutter"), lambda: 100 * _c("n_stutter") > 20 * _c("n_words")),
)


def with_features(df: DataFrame, groups: Sequence[str], alive: Column) -> DataFrame:
    """Adds the groups that are not there yet, with what they read."""
    for group in groups:
        add, reads = FEATURES[group]
        df = with_features(df, reads, alive)
        if P + "has_" + group not in df.columns:
            df = add(df, alive).withColumn(P + "has_" + group, F.lit(True))
    return df


def sample(df: DataFrame, text: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` texts, stored in one file: those whose hash falls below their share of all rows. It depends on
    the texts alone, not on their order or their files; copies are all in it or none is, so a hot one is kept to one."""
    rows = df.select(T.whole(F.col(text)).alias(TEXT))
    total = rows.count()
    parts = max(1, total // max(1, sample_rows))
    chosen = rows.where(F.pmod(F.xxhash64(TEXT, F.lit(7)), F.lit(parts)) == 0).dropDuplicates([TEXT])
    return runtime.store(chosen.coalesce(1), "quality-sample")


def _cpu_seconds(probe: DataFrame) -> tuple[float, list]:
    """What the executors' threads worked for one job, by Spark's own metrics, and its rows."""
    sc = probe.sparkSession.sparkContext
    group = f"lorekeep-{uuid.uuid4().hex}"
    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    sc.setJobGroup(group, "quality rules: measure")
    try:
        rows = probe.collect()
    finally:
        for k, v in before.items():
            sc.setLocalProperty(k, v)
    scala = sc._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    stages = {s for job in jobs if job is not None for s in job.stageIds}
    return sum(scala.statusStore().lastStageAttempt(s).executorCpuTime() for s in stages) / 1e9, rows


def measure(df: DataFrame, text: str, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, given: Sequence[str] = ()) -> list[RuleStats]:
    """Each rule's rejection rate, and the CPU seconds that it adds, on a sample; the features ``given`` are there anyway.

    Only counts leave the executors. The sample is stored with the given features, so that a run reads them and computes no
    more than its rule adds. The least of a few runs counts, less the least of runs with no rule in it.
    """
    base = sample(df, text, sample_rows)
    if given:
        base = runtime.store(with_features(base, given, F.lit(True)), "quality-sample")

    def probe(rule: Rule | None) -> DataFrame:
        """A new plan each time: Spark would reuse the stages of an old one."""
        if rule is None:
            return base.agg(F.count(F.lit(1)), F.lit(0), F.sum(F.length(TEXT)))
        rows = with_features(base, rule.needs, F.lit(True)).withColumn("r", F.coalesce(rule.rejects(), F.lit(False)).cast("int"))
        return rows.agg(F.count(F.lit(1)), F.sum("r"), F.sum(F.length(TEXT)))

    def run(rule: Rule | None) -> tuple[float, float]:
        took = [_cpu_seconds(probe(rule)) for _ in range(RUNS)]
        rows, rejected = took[-1][1][0][:2]
        return min(t for t, _ in took), (rejected or 0) / max(1, rows)

    idle = run(None)[0]
    return [RuleStats(rule, share, max(0.0, took - idle)) for rule in rules for took, share in [run(rule)]]


def ordered(stats: Sequence[RuleStats]) -> list[Rule]:
    """The rules by rejection per cost, the best first; ties stay in the given order."""
    best = sorted(stats, key=lambda s: -s.worth)
    LOG.info("quality rules: %s", ", ".join(f"{s.rule.name} ({s.rejection:.4f} in {s.seconds:.3f} s)" for s in best))
    return [s.rule for s in best]


def _apart(df: DataFrame, text: str) -> DataFrame:
    """The text beside all columns of the input as one, so that a feature clashes with none of them."""
    return df.select(F.struct("*").alias(GIVEN), T.whole(F.col(f"`{text}`")).alias(TEXT))


def _given(columns: Sequence[str]) -> list[Column]:
    return [F.col(GIVEN)[c].alias(c) for c in columns]


def cascade(df: DataFrame, rules: Sequence[Rule], alive: Column | None = None) -> DataFrame:
    """Adds ``__q_rejected_by``, the first rule in this order that rejects a row, else null. Rows that are not
    ``alive`` are not looked at."""
    given = F.lit(True) if alive is None else alive
    df = df.withColumn(P + "rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        still = given & _c("rejected_by").isNull()
        df = with_features(df, rule.needs, still)
        verdict = F.when(still & F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name))
        df = df.withColumn(P + "rejected_by", F.coalesce(_c("rejected_by"), verdict))
    return df


#: Features that the report has for every row, whatever the verdict.
FIGURES = ("words", "word_chars", "symbols", "lines", "repeats")
REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def quality_report(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The input's columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    rejected_by: the figures for every row, and the cascade's verdict on rows that the base rules pass."""
    rules = ordered(measure(df, text, rules, sample_rows, FIGURES))
    out = with_features(_apart(df, text), FIGURES, F.lit(True))
    failed = FEW_WORDS.rejects() | REPEATS.rejects()
    out = cascade(out.withColumn(P + "base_failed", failed), rules, alive=~_c("base_failed"))
    out = out.withColumn(P + "kept", ~_c("base_failed") & _c("rejected_by").isNull())
    return out.select(*_given([c for c in df.columns if c not in REPORT]), *(_c(c).alias(c) for c in REPORT))


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = (*BASE_RULES, *RULES), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the input's columns: here every rule stands in the cascade."""
    out = cascade(_apart(df, text), ordered(measure(df, text, rules, sample_rows)))
    # Without a column that isn't deterministic, Catalyst would push the filter below the cascade and copy all
    # expressions into it, each feature many times over.
    out = out.withColumn(P + "fence", F.monotonically_increasing_id())
    return out.where(_c("rejected_by").isNull() & (_c("fence") >= 0)).select(*_given(df.columns))
