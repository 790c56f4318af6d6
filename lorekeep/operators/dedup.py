"""Greedy near-duplicate removal within sources: the longest record first, and a record goes if it is near one that was kept.

Order decides: a record near one that went itself is not lost by that. Record by record this is one loop over each source; here the
same result comes from rounds over whole tables.

Records are sets of words; two are near if their Jaccard distance is under ``threshold``. Sets that equal one another are one, as
all but the first of them go in any case. Sets of similar size are cut into more ranges of the hash space than near ones differ in
words, so near sets have a range alike: what is in a range, with the source, is a key under which candidates meet. Keys
that one record alone has are dropped at once, and only words of records that meet another are stored. Of candidates only those
are compared that share as many keys as near sets are certain to, SPARE + 1 if one of the two has no empty range; and about as many
pairs at a time as there are records, so that the words of pairs that lie on a disk at once grow with the records, not with the pairs.

1. While keys have large groups, leaders are taken: records that come first under each of their keys, which nothing before can
   remove. Records near a leader go. A key has one leader at most, so a group of near copies of any size costs one
   comparison for each of its records, never its pairs.
2. Once groups are small, candidate pairs are compared, and the choice is made on the pairs that are near: what no
   record before it is near to stays, what is near to one that stays goes, until no pair is open.

Where thresholds over ``RANGES_UP_TO`` make ranges too small, keys are the rarest words of a record instead, as many as near sets can't
all miss. Word frequencies are only looked up for words in many records; all others count as rare. Keys change how much is
compared, not what is found. Nothing is capped: after ``LEADER_ROUNDS`` rounds the second way takes what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lorekeep.engine.shared import drop, sieve, small, store

#: Records of a source worth looking at, the least characters of a record that may stay, and what counts as near.
LEAST_GROUP, SHORTEST, THRESHOLD = 5, 20, 0.15
WORD = r"([\p{L}\p{N}_]{2,})"
#: A word is frequent if more than one of so many records has it; there are at most that many times the words of a record of them.
FREQUENT = 1000
#: Candidate pairs for each record up to which they are compared at once, and rounds of leaders at most.
PAIRS, LEADER_ROUNDS = 64, 25
#: The greatest threshold for keys of ranges, ranges that near sets have alike beyond one, and words worked on at once.
RANGES_UP_TO, SPARE, WORDS = 0.5, 2, 1_000_000


def in_scope(records: DataFrame, source: str | None = None, domain: str | None = None) -> DataFrame:
    """Records of sources whose name contains ``source``, in any case, and of ``domain``; null takes all."""
    out = records if domain is None else records.where(F.col("domain") == domain)
    return out if source is None else out.where(F.contains(F.lower("source_file"), F.lit(source.lower())))


def word_set(text: Column) -> Column:
    """The distinct words of a text as sorted hashes of 64 bits; null has none."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 1), lambda w: F.xxhash64(F.lower(w)))
    return F.sort_array(F.array_distinct(words))  # not array_sort, whose comparisons are interpreted


def near_duplicates(records: DataFrame, threshold: float = THRESHOLD, least_group: int = LEAST_GROUP, shortest: int = SHORTEST) -> DataFrame:
    """(id, source_file, decision): 'kept', 'short' (under ``shortest`` characters), 'duplicate', or 'unchecked' where a source has
    fewer than ``least_group`` records. ``records`` has id, source_file and document; ids are distinct and not null. Of
    records equally long the lesser id comes first; records without a word are near nothing; a null source is a source."""
    source = F.coalesce(F.col("source_file"), F.lit("")).alias("source")
    chars = F.coalesce(F.length("document"), F.lit(0)).alias("chars")
    rows = records.select("id", "source_file", source, chars, word_set(F.col("document")).alias("words"))
    digest = F.md5(F.array_join(F.col("words").cast("array<string>"), ",").cast("binary"))
    rows = store(rows.select("id", "source_file", "source", "chars", F.when(F.size("words") > 0, digest).alias("set")), "dedup-rows")
    groups = store(rows.groupBy("source").agg(F.count(F.lit(1)).alias("records")), "dedup-groups")
    rows = rows.join(small(groups), "source")
    checked = F.col("records") >= least_group
    order = F.struct((-F.col("chars")).alias("shorter"), F.col("id"))
    named = rows.where(checked & (F.col("chars") >= shortest) & F.col("set").isNotNull())
    sets = store(named.groupBy("source", "set").agg(F.min(order).alias("first")), "dedup-sets")
    later = store(named.join(sets, ["source", "set"]).where(F.col("first") < order).select("id"), "dedup-later")
    drop(sets)
    texts = records.select("id", source, chars, "document").join(small(groups), "source").where(checked & (F.col("chars") >= shortest))
    base = texts.join(small(later), "id", "left_anti").select("id", "source", order.alias("order"), word_set(F.col("document")).alias("words"))
    gone = removed(base, threshold)
    out = store(gone.select("id").unionByName(later).withColumn("gone", F.lit(True)), "dedup-out")
    decided = rows.join(small(out), "id", "left")
    decision = F.when(~checked, "unchecked").when(F.col("chars") < shortest, "short").when(F.col("gone"), "duplicate").otherwise("kept")
    return decided.select("id", "source_file", decision.alias("decision"))


def outcome(decisions: DataFrame) -> DataFrame:
    """(source_file, records, kept, removed) of the sources that were looked at."""
    went = F.count_if(F.col("decision").isin("short", "duplicate"))
    looked = decisions.where("decision <> 'unchecked'").groupBy("source_file")
    return looked.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("decision") == "kept").alias("kept"), went.alias("removed"))


def keys(base: DataFrame, threshold: float) -> DataFrame:
    """(key, id) of (id, source, words): near sets of a source share a key."""
    return _keyed(base, threshold).select("key", "id")


def _keyed(base: DataFrame, threshold: float) -> DataFrame:
    """``keys`` with ``need``: how many keys a near set shares with the record at least."""
    if threshold > RANGES_UP_TO:
        return _word_keys(base, threshold).withColumn("need", F.lit(1))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("words").offsets.to_numpy())
            parts = np.cumsum(sizes) // WORDS
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end > start:
                    yield range_keys(batch.slice(start, end - start), threshold)

    return base.select("id", F.xxhash64("source").alias("source"), "words").mapInArrow(made, StructType([StructField("key", LongType()), base.schema["id"], StructField("need", IntegerType())]))


def schemes(most: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The least sizes of buckets up to ``most`` words, and how many ranges the sets of each bucket and the next are cut into: 0 where
    near sets of these sizes equal one another. Near sets lie in one bucket or in two adjacent ones."""
    over = threshold + 1e-6  # distances are rounded to six digits
    lows = [1]
    while lows[-1] <= most:
        lows.append(int(lows[-1] / (1 - over)) + 1)
    lows += [int(lows[-1] / (1 - over)) + 1]
    differ = [int(over / (2 - over) * (lows[i + 1] - 1 + lows[i + 2] - 1)) for i in range(len(lows) - 2)]
    return np.array(lows[:-2]), np.array([d + 1 + SPARE if d else 0 for d in differ])


def range_keys(batch: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    """(key, id, need) of (id, source, words), words sorted: each set's ranges by its own bucket's scheme and by the one below. Sets differ in
    fewer ranges than there are, by SPARE + 1 at least; empty ranges are keys only of sets that have more than SPARE of them. All
    ranges that a set without empty ones has alike with another are keys of both."""
    listed, source = batch.column("words"), batch.column("source").to_numpy().view(np.uint64)
    offsets = listed.offsets.to_numpy()
    words = listed.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    sizes = np.diff(offsets)
    lows, cut = schemes(int(sizes.max(initial=1)), threshold)
    own = np.searchsorted(lows, sizes, side="right") - 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    spread = (words ^ np.uint64(1 << 63)) >> np.uint64(32)
    found, gap = [], np.zeros(len(sizes), bool)
    for scheme in (own, own - 1):
        ranges = np.where(scheme >= 0, cut[np.maximum(scheme, 0)], 0)
        here = ranges[row] > 0
        at, place = row[here], spread[here] * ranges[row[here]].astype(np.uint64) >> np.uint64(32)
        if not len(at):
            continue
        starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (place[1:] != place[:-1])])
        sums, rows, places = np.add.reduceat(words[here], starts), at[starts], place[starts]
        filled = np.bincount(rows, minlength=len(sizes))
        gap |= ranges > filled
        empty = np.flatnonzero(ranges - filled > SPARE)
        if len(empty):
            ends = np.searchsorted(rows, [empty, empty + 1])
            free = [np.setdiff1d(np.arange(ranges[r]), places[a:b]) for r, a, b in zip(empty, *ends, strict=True)]
            rows = np.r_[rows, np.repeat(empty, [len(f) for f in free])]
            places = np.r_[places, np.concatenate(free).astype(np.uint64)]
            sums = np.r_[sums, np.zeros(len(rows) - len(sums), np.uint64)]
        mixed = source[rows] ^ (scheme[rows].astype(np.uint64) << np.uint64(32)) ^ places
        for part in (sums, np.uint64(0)):
            mixed = (mixed ^ (mixed >> np.uint64(31)) ^ part) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed ^ (mixed >> np.uint64(32)), rows))
    key = np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)]).view(np.int64)
    rows = np.concatenate([r for _, r in found] or [np.zeros(0, np.int64)])
    need = np.where(gap, 1, SPARE + 1).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), batch.column("id").take(pa.array(rows)), pa.array(need[rows])], names=["key", "id", "need"])


def _word_keys(base: DataFrame, threshold: float) -> DataFrame:
    """(key, id): a record under each of its rarest words, as many as near sets can't all miss."""
    words = base.select("id", F.explode("words").alias("word"))
    least = base.count() // FREQUENT
    counts = store(words.groupBy("word").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") > least + 1), "dedup-frequent")
    ranked = words.join(small(counts), "word", "left").select("id", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word").alias("r"))
    sorted_ = ranked.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    n = F.size("words")
    prefix = n - F.ceil(F.round(n * (1 - threshold), 6)) + 1
    return base.join(sorted_, "id").select(F.explode(F.slice(F.col("r.word"), F.lit(1), prefix.cast("int"))).alias("word"), "id", "source").select(F.xxhash64("source", "word").alias("key"), "id")


def near(pairs: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """Those of (a, b, need), two ids in a row for each key they share, whose distance is under the threshold, each once."""
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("need")).where("shared >= need")
    pairs = store(pairs.select("a", "b"), "dedup-pairs")
    parts = max(-(-pairs.count() // max(base.count(), 1)), 1)
    if parts == 1:
        return _compared(small(pairs), pairs, base, threshold)
    part = F.pmod(F.xxhash64("a", "b"), F.lit(parts))
    cut = (store(pairs.where(part == i), "dedup-part") for i in range(parts))
    return reduce(DataFrame.unionByName, [store(_compared(small(some), some, base, threshold), "dedup-compared") for some in cut])


def _compared(marked: DataFrame, pairs: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """``near`` of distinct pairs; ``marked`` are the same, perhaps marked for a broadcast."""

    def side(x: str) -> DataFrame:
        held = sieve(base, F.xxhash64("id"), pairs.select(F.xxhash64(x).alias("key")))
        return held.select(F.col("id").alias(x), F.col("source").alias(f"{x}_source"), F.col("words").alias(f"{x}_words"))

    both = side("b").join(marked, "b").join(side("a"), "a").where("a_source = b_source")
    common = F.size(F.array_intersect("a_words", "b_words"))
    union = F.size("a_words") + F.size("b_words") - common
    return both.where(F.round((union - common) / union, 6) < threshold).select("a", "b")


def removed(base: DataFrame, threshold: float, pairs_each: int = PAIRS, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """The ids that go, of (id, source, order, words) with distinct sets; empty ones meet nothing."""
    met = _keyed(base, threshold).withColumn("here", F.count(F.lit(1)).over(Window.partitionBy("key")))
    met = store(met.where("here > 1").select("key", "id", "need"), "dedup-met")
    ids = store(met.select("id").distinct(), "dedup-ids")
    base = store(base.join(small(ids), "id", "left_semi").withColumn("n", F.size("words")), "dedup-words")
    live = store(met.join(small(store(base.select("id", "order", "n"), "dedup-live")), "id"), "dedup-keys")
    drop(met, ids)
    alike = lambda a, b: F.least(a, b) >= F.round(F.greatest(a, b) * (1 - threshold), 6)
    gone: list[DataFrame] = []
    for _ in range(leader_rounds):
        first = store(live.groupBy("key").agg(F.min("order").alias("first"), F.min_by("n", "order").alias("first_n"), F.min_by("need", "order").alias("first_need"), F.count(F.lit(1)).alias("here")).where("here > 1"), "dedup-first")
        load = first.agg(F.coalesce(F.sum(F.col("here") * (F.col("here") - 1) / 2), F.lit(0))).first()[0]
        if load <= pairs_each * live.select(F.approx_count_distinct("id")).first()[0]:
            break
        marked = live.join(first, "key", "left").withColumn("leads", F.coalesce(F.col("first") == F.col("order"), F.lit(True)))
        leaders = store(marked.groupBy("id").agg(F.bool_and("leads").alias("leads")).where("leads").select("id"), "dedup-leaders")
        met = marked.where(~F.col("leads") & alike(F.col("n"), F.col("first_n"))).select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.greatest("need", "first_need").alias("need"))
        led = met.join(small(leaders.withColumnRenamed("id", "a")), "a", "left_semi")
        near_leader = store(near(led, base, threshold).select(F.col("b").alias("id")).distinct(), "dedup-near")
        after = store(live.join(small(leaders), "id", "left_anti").join(small(near_leader), "id", "left_anti"), "dedup-keys")
        gone.append(near_leader)
        drop(live, first, leaders)
        live = after
    gone.append(_by_pairs(live, base, threshold, alike))
    return reduce(DataFrame.unionByName, gone)


def _by_pairs(live: DataFrame, base: DataFrame, threshold: float, alike) -> DataFrame:
    a, b = live.alias("a"), live.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.order") < F.col("b.order")) & alike(F.col("a.n"), F.col("b.n"))
    met = a.join(b, meet).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.greatest("a.need", "b.need").alias("need"))
    edges = store(near(met, base, threshold), "dedup-edges")
    gone = [edges.limit(0).select(F.col("b").alias("id"))]
    while not edges.isEmpty():
        blocked = edges.select(F.col("b").alias("a")).distinct()
        free = edges.join(blocked, "a", "left_anti")  # from records that stay
        goes = store(free.select(F.col("b").alias("id")).distinct(), "dedup-goes")
        left = edges
        for end in ("a", "b"):
            left = left.join(small(goes.withColumnRenamed("id", end)), end, "left_anti")
        after = store(left.select("a", "b"), "dedup-edges")
        gone.append(goes)
        drop(edges)
        edges = after
    return reduce(DataFrame.unionByName, gone)
