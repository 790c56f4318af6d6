"""Benchmark decontamination by spaced seeds (DataFrame functions only).

Texts become tokens: lower-case runs of letters and digits. A mask of fixed shape is laid on every window of tokens,
and the tokens at its marked places are hashed together; tokens at the other places may be anything, so a window in
which words were exchanged there still has the same hash. Hashes of documents are joined with those of the benchmark.
A hit puts a document and an item side by side at a fixed distance; along this alignment the best stretch is scored
(a match counts 1, another token -2, and the stretch with the largest sum counts), and the pair is reported if the
score reaches ``score`` or, for an item with fewer tokens than that, if all of it matches.

Scale: hashing adds no shuffle. The benchmark's hashes are broadcast only if they are few enough (their number is
counted first); beyond that the join is a shuffle of (hash, document, place). Documents with hits are read again for
the check. Repeated passages give hits at many distances in one document, each checked by itself.

Defined results: a null or empty text or item has no tokens and is in no pair; an item shorter than the masks is looked
for as a whole, at every place; ids may repeat, a pair (doc_id, item_id) is reported once with its best stretch;
rows with a null id are in no pair; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import runtime
from lorekeep.llm import text as T

#: The masks: 1 marks a token that counts. Each has weight 7 and begins and ends with a mark.
MASKS = ("1101011011", "111001010011", "1010110100101")
#: The least score of a reported stretch, and what another token costs.
SCORE, COST = 12, 2
#: Benchmark hashes (about 32 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(T.whole(text)), r"[^\p{L}\p{N}]+", -1), "")


def hashes(text: Column) -> Column:
    """A hash for each token."""
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(h: Column) -> Column:
    """(at, seed) for every mask at every window; a text shorter than a mask has none of it."""

    def of(n: int, mask: str) -> Column:
        places = [k for k, mark in enumerate(mask) if mark == "1"]
        last = F.size(h) - len(mask)
        seed = lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), *(F.get(h, i + k) for k in places)).alias("seed"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), seed)).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))

    return F.concat(*(of(n, mask) for n, mask in enumerate(MASKS)))


def short_seeds(h: Column, sizes: list[int]) -> Column:
    """(at, seed) for whole windows of the sizes of short items."""

    def of(size: int) -> Column:
        seed = lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(-size), *(F.get(h, i + k) for k in range(size))).alias("seed"))
        return F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), seed)).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))

    return F.concat(*(of(s) for s in sizes))


def best_stretch(aligned: Column) -> Column:
    """The largest sum over a stretch of ``aligned`` booleans, and the number of matches and tokens in it."""
    zero = F.lit(0)
    fresh = lambda s, m, n: F.struct(s.alias("s"), m.alias("m"), n.alias("n"))
    start = F.struct(fresh(zero, zero, zero).alias("now"), fresh(zero, zero, zero).alias("best"))

    def step(acc: Column, same: Column) -> Column:
        s = acc["now"]["s"] + F.when(same, 1).otherwise(-COST)
        now = F.when(s > 0, fresh(s, acc["now"]["m"] + same.cast("int"), acc["now"]["n"] + 1)).otherwise(fresh(zero, zero, zero))
        return F.struct(now.alias("now"), F.when(now["s"] > acc["best"]["s"], now).otherwise(acc["best"]).alias("best"))

    return F.aggregate(aligned, start, step, lambda acc: acc["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", score: int = SCORE) -> DataFrame:
    """Returns (doc_id, item_id, score, matched, stretch, item_tokens, shift) for every contaminated pair:
    ``shift`` is the document's token that stands beside the item's first."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), hashes(F.col(item_text)).alias("ih")).where("size(ih) > 0")
    short = F.size("ih") < min(map(len, MASKS))
    # Numbers below the length of a mask: a few at most.
    sizes = sorted(r[0] for r in items.where(short).select(F.size("ih")).distinct().collect())
    own = F.when(short, short_seeds(F.col("ih"), sizes)).otherwise(seeds(F.col("ih"))) if sizes else seeds(F.col("ih"))
    probes = items.select("item_id", F.explode(own).alias("p")).select("item_id", F.col("p.at").alias("i"), F.col("p.seed").alias("seed"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    dh = F.col("dh")
    every = F.concat(seeds(dh), short_seeds(dh, sizes)) if sizes else seeds(dh)
    found = texts.select("doc_id", hashes(F.col("body")).alias("dh")).select("doc_id", F.explode(every).alias("p"))
    found = found.select("doc_id", F.col("p.at").alias("d"), F.col("p.seed").alias("seed"))
    hits = found.join(_small(probes), "seed").select("doc_id", "item_id", (F.col("d") - F.col("i")).alias("shift")).distinct()
    hits = runtime.store(hits, "spaced-seed-hits")
    # The check: both token lists along the alignment, for documents with hits only.
    hit_docs = texts.join(_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    sided = hit_docs.select("doc_id", hashes(F.col("body")).alias("dh")).join(hits, "doc_id").join(_small(items), "item_id")
    first = F.greatest(F.lit(0), -F.col("shift"))
    count = F.least(F.size("ih"), F.size("dh") - F.col("shift")) - first
    same = F.zip_with(F.slice("ih", first + 1, count), F.slice("dh", F.col("shift") + first + 1, count), lambda a, b: a == b)
    scored = sided.where(count > 0).select("doc_id", "item_id", "shift", F.size("ih").alias("item_tokens"), best_stretch(same).alias("b"))
    best = F.max(F.struct(F.col("b.s").alias("score"), F.col("b.m").alias("matched"), F.col("b.n").alias("stretch"), "item_tokens", (-F.col("shift")).alias("back"))).alias("x")
    # The threshold comes after the maximum: before it, Catalyst would copy the scoring into the join.
    out = scored.groupBy("doc_id", "item_id").agg(best).where(F.col("x.score") >= F.least(F.lit(score), F.col("x.item_tokens")))
    return out.select("doc_id", "item_id", "x.score", "x.matched", "x.stretch", "x.item_tokens", (-F.col("x.back")).cast("int").alias("shift"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast, if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in no contaminated pair, with their columns; rows with a null id stay."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(_small(runtime.store(found, "contaminated")), id_col, "left_anti")
