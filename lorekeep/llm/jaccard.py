"""N-gram Jaccard join with prefix trees, down to connected components.

A document is the set of its distinct shingles of ``size`` words, as 64-bit hashes (two different shingles of compared
documents share a hash with a probability of about 1e-13). Two documents link if 100 * intersection >= percent * union.
Op9's contract has 3 words and 90 percent, the defaults; the numbers below are for it, and follow from ``percent``.

1. Sets. Documents with equal sets (128-bit digest) form a class, of which the least doc_id stands for all. Each set
   is cut into ranges of the hash space; a range's digest is a key. Linked sets differ in at most d = (a + b) / 19
   shingles, so with d + 3 ranges at least three agree; sets of similar size (buckets of ratio 10/9, each set in its
   own bucket's scheme and in the one below) share a key. A set leaves out keys of empty ranges unless it has
   three or more, in which case an agreement on empty ranges alone is possible; with a lower percentage ranges hold
   fewer shingles, and there are more than d + 3, so that so many empty ones stay rare. No frequency of a shingle matters: a
   passage that many documents share makes no key unless all else in a range is equal too.
2. Candidates. Keys that two classes share connect them to the key's least class; connected components of this
   graph are the groups that have to be compared, and hold every link.
   Below RANGES_FROM percent a range holds few shingles (4.5 at 80), so documents that share a passage agree on one, and more
   so the more documents there are, until nearly all are one group. There a set's keys are its rare shingles: in one order of
   all shingles (those in the lowest part of the hash space first, by how many documents have them; then the others, by hash)
   linked sets share one of the first n - ceil(percent * n / 100) + 1. That part is twice as large as what may differ, so only it
   is counted. Shingles that one document alone has fill most of those places, and connect nothing.
3. Prefix trees. A group's sets, shingles in one order for all (frequent first, then by hash), go into a tree in
   which common beginnings are stored once. Each set walks the tree: overlaps with a shared beginning are counted
   once for all sets below it, and a subtree is left as soon as the overlap so far plus what can remain (of the set, or
   of the longest path below) stays under what the least set below needs. Subtrees that already belong to the
   walking set's component are skipped, which makes a group of near copies linear.
4. Groups over ``block_tokens`` shingles are split into blocks. First each block is walked together with the group's
   least class, which joins a large group of near copies at once. Passages that many documents share can make such a
   group of documents that don't link, so its sets then get keys that passages don't fill: rare shingles, counted over the
   whole hash space and the large groups alone. Groups of
   what these keys still connect across components are formed anew, and all pairs of their blocks are walked. No
   link is lost, and no task holds more than two blocks.

Links become spanning edges, and edges components (see ``components``). Nothing but counts reaches the driver.

Defined results: a document without words, or with a null text, has the empty set, links with nothing and is its own
component; with fewer words than a shingle, its whole sequence is its only shingle; rows that share a doc_id are one document
with several sets; rows with a null doc_id link with nothing and get a null component_id; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm import runtime
from lorekeep.llm.components import components

#: Fixed values of the contract: A-Z to lower case, and nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Odd multipliers that tell the places of a shingle's words apart, by how many words there are.
PLACES = [np.array(x, dtype=np.uint64) for x in ((0x9E3779B97F4A7C15,), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F), (0xEB44ACCAB455D165, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB), (0x9FB21C651E98DF25, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xCBF29CE484222325))]
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000
#: Ranges beyond those that can differ, at least.
SPARE = 2
#: Words of a shingle and percentage of op9's contract.
SIZE, PERCENT = 3, 90
#: From this percentage on ranges are keys, below it rare shingles.
RANGES_FROM = 90
#: Classes (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SETS = "doc_id long, n long, sig binary, keys array<long>"
MEMBERS = "comp long, i int, j int, side int, doc_id long, n long, tokens binary"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, known: WordHashes, size: int = SIZE) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    out = h[: len(h) - k + 1] * PLACES[k - 1][0]
    for p in range(1, k):
        out = out + h[p : len(h) - k + 1 + p] * PLACES[k - 1][p]
    return np.unique(mix(out))


@cache
def starts(percent: int = PERCENT) -> np.ndarray:
    """Least set sizes of the buckets; below the first only equal sets link."""
    out = [-(-percent // (100 - percent))]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


@cache
def ranges(bucket: int, percent: int = PERCENT) -> tuple[int, int]:
    """Ranges of the scheme for pairs whose smaller set is in ``bucket``, and how many of them agree but for one.

    Of d ranges for the shingles that differ, the smallest sets leave exp(-p * p / (1 - p)) empty on average: twice that
    share is spare (none at 90 percent).
    """
    most = int(starts(percent)[bucket + 1]) - 1
    differ = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
    spare = SPARE + differ * round(200 * math.exp(-percent * percent / (100 * (100 - percent)))) // 100
    return differ + 1 + spare, spare


def range_keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    least = starts(percent)
    if len(tokens) < least[0]:
        return np.empty(0, np.int64)
    own = int(np.searchsorted(least, len(tokens), "right")) - 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(tokens))))
    out = []
    for bucket in (own, own - 1) if own else (own,):
        k, spare = ranges(bucket, percent)
        place = ((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        cuts = np.searchsorted(place, np.arange(k + 1, dtype=np.uint64))
        keys = mix(mix(sums[cuts[1:]] - sums[cuts[:-1]]) + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(bucket * 0x2545F4914F6CDD1D & (1 << 64) - 1))
        full = cuts[1:] > cuts[:-1]
        out.append(keys if k - np.count_nonzero(full) > spare else keys[full])
    return np.concatenate(out).view(np.int64)


def first_of(n: int, percent: int) -> int:
    """So many of a set's shingles, in any order for all sets, have one in common with each set that it links to."""
    return n - -(-percent * n // 100) + 1


def counted(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which the rarest can be keys: those in the lowest part of the hash space, and the next ones where that
    part has too few of them. Sets that only equal ones link to have none."""
    if len(tokens) < starts(percent)[0]:
        return np.empty(0, np.int64)
    part = min((1 << 64) - 1, (2 * (100 - percent) << 64) // 100)
    return tokens[: max(first_of(len(tokens), percent), int(np.searchsorted(tokens, np.uint64(part), "right")))].view(np.int64)


def sets(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, sig, keys) of (doc_id, body); below RANGES_FROM percent the keys are what ``_rare`` chooses from."""
    keys_of = range_keys if percent >= RANGES_FROM else counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, sig, keys = [], [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), known, size)
                n.append(len(tokens))
                sig.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                keys.append(keys_of(tokens, percent))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            values = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "keys"])

    return docs.mapInArrow(run, SETS)


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets with so many shingles."""
    return -(-percent * (a + b) // (100 + percent))


class Node:
    """A stretch of the tree: the ranks on it, what hangs below, and bounds over all sets at or below it."""

    __slots__ = ("ranks", "children", "sets", "rest", "least", "most", "last", "one")

    def __init__(self, ranks: np.ndarray):
        self.ranks, self.children, self.sets = ranks, [], []
        self.rest, self.least, self.most, self.last = 0, 1 << 60, 0, -1
        self.one = -1  # a set, if all at or below are known to be in its component

    def close(self, sizes: list[int]) -> None:
        for s in self.sets:
            self.least, self.most, self.last = min(self.least, sizes[s]), max(self.most, sizes[s]), max(self.last, s)
        for c in self.children:
            self.rest = max(self.rest, c.rest + len(c.ranks))
            self.least, self.most, self.last = min(self.least, c.least), max(self.most, c.most), max(self.last, c.last)


def build(ranked: list[np.ndarray], sizes: list[int]) -> Node:
    """The tree of the sets, put in lexicographic order; ``path`` holds the nodes of the last one with their depths."""
    root = Node(np.empty(0, np.int64))
    path: list[tuple[Node, int]] = [(root, 0)]
    previous = np.empty(0, np.int64)
    for s in sorted(range(len(ranked)), key=lambda s: ranked[s].tolist()):
        now = ranked[s]
        n = min(len(previous), len(now))
        differ = np.flatnonzero(previous[:n] != now[:n])
        shared = int(differ[0]) if len(differ) else n
        while len(path) > 1 and path[-2][1] >= shared and path[-1][1] > shared:
            path.pop()[0].close(sizes)
        top, depth = path[-1]
        if depth > shared:  # the common part ends inside this stretch: cut it
            start = path[-2][1]
            upper = Node(top.ranks[: shared - start])
            top.ranks = top.ranks[shared - start :]
            top.close(sizes)
            upper.children.append(top)
            path[-2][0].children[-1] = upper
            path[-1] = (upper, shared)
        if len(now) > shared:
            leaf = Node(now[shared:])
            path[-1][0].children.append(leaf)
            path.append((leaf, len(now)))
        path[-1][0].sets.append(s)
        previous = now
    while path:
        path.pop()[0].close(sizes)
    return root


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def walk(root: Node, x: int, own: np.ndarray, sizes: list[int], inside: np.ndarray, union: Union, sides: list[int] | None, percent: int = PERCENT) -> None:
    """Links set ``x`` with the sets after it that need it, skipping what is in its component already."""
    size = sizes[x]
    # Children are visited after their parent and settled (``one``) before it: a stack with two visits each.
    stack: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while stack:
        node, overlap, done = stack.pop()
        if done:
            tops = {union.find(s) for s in node.sets} | {union.find(c.one) if c.one >= 0 else -1 for c in node.children}
            if len(tops) == 1 and -1 not in tops:
                node.one = tops.pop()
            continue
        if node.last <= x or (node.one >= 0 and union.find(node.one) == union.find(x)):
            continue
        if 100 * node.most < percent * size or percent * node.least > 100 * size:
            continue
        if len(node.ranks):
            overlap += int(np.count_nonzero(inside[node.ranks]))
            left = len(own) - int(np.searchsorted(own, node.ranks[-1], "right"))
        else:
            left = len(own)
        if overlap + min(left, node.rest) < needed(size, max(node.least, -(-percent * size // 100)), percent):
            continue
        for y in node.sets:
            if y > x and overlap >= needed(size, sizes[y], percent) and (sides is None or sides[x] != sides[y]):
                union.join(x, y)
        stack.append((node, overlap, True))
        stack.extend((c, overlap, False) for c in node.children)


def tree_join(tokens: list[np.ndarray], sides: list[int] | None = None, percent: int = PERCENT) -> Union:
    """Components of the links among the sets; with ``sides``, of links between different sides only."""
    sizes = [len(t) for t in tokens]
    union = Union(len(tokens))
    values, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    # Shingles of one set only can't overlap: they count for its size, and aren't in the tree.
    shared = int(np.count_nonzero(counts > 1))
    ranked, at = [], 0
    for t in tokens:
        r = np.sort(rank[inverse[at : at + len(t)]])
        ranked.append(r[: int(np.searchsorted(r, shared))])
        at += len(t)
    root, inside = build(ranked, sizes), np.zeros(shared + 1, bool)
    for x, own in enumerate(ranked):
        inside[own] = True
        walk(root, x, own, sizes, inside, union, sides, percent)
        inside[own] = False
    return union


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast, if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _compare(docs: DataFrame, tasks: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning edges (u, v) of the links in each task (comp, i, j, side, doc_id); texts are read again for these only."""
    rows = tasks.count()
    picked = docs.join(_small(tasks, rows), "doc_id").select("comp", "i", "j", "side", "doc_id", "body")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py(), known, size) for t in batch.column(5)]
            columns = [*batch.columns[:5], pa.array([len(t) for t in found], pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MEMBERS.split(", ")])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in groupby(members(batches), key=lambda r: r[:3]):
            part = list(group)
            union = tree_join([np.frombuffer(r[6], np.uint64) for r in part], [r[3] for r in part] if i != j else None, percent)
            edges = [(part[union.find(k)][4], r[4]) for k, r in enumerate(part) if union.find(k) != k]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["u", "v"])

    sent = picked.mapInArrow(tokens, MEMBERS).where("n > 0")
    return sent.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "n", "doc_id").mapInArrow(join, "u long, v long")


def _blocks(groups: DataFrame, sizes: DataFrame, block_tokens: int) -> DataFrame:
    """(comp, doc_id, block, blocks): a group's documents spread by hash over as many blocks as its shingles fill."""
    placed = groups.join(sizes, groups["id"] == sizes["doc_id"]).select(F.col("label").alias("comp"), "doc_id", "n")
    blocks = placed.groupBy("comp").agg(F.ceil(F.sum("n") / F.lit(block_tokens)).cast("int").alias("blocks"))
    spread = F.pmod(F.xxhash64("doc_id"), F.greatest("blocks", F.lit(1))).cast("int")
    return placed.drop("n").join(blocks, "comp").select("comp", "doc_id", spread.alias("block"), "blocks")


def _candidates(keyed: DataFrame) -> DataFrame:
    """Edges from each (key, doc_id) to the key's least document, where there is another.

    Keys are shuffled once, for the ends and for the join with them. A key that very many documents have is no window: its
    ends are aggregated as its rows pass, and a document has dozens of keys, so one key's rows are a small part of all.
    """
    dealt = keyed.select("key", "doc_id").repartition("key")
    ends = dealt.groupBy("key").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("last")).where("v < last").select("key", "v")
    return dealt.join(ends, "key").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1_000_000, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id) for every row of ``df``: shingles of ``size`` words (5 at most), links from
    a similarity of ``percent`` (50 to 99) on."""
    if not (1 <= size <= len(PLACES) and 50 <= percent <= 99):
        raise ValueError(f"no shingles of {size} words, or no links from {percent} percent")
    runtime.ship(df.sparkSession)
    docs = df.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"CAST(CAST(`{text_col}` AS string) AS binary) AS body")
    wide = runtime.store(sets(docs, size, percent), "jaccard-keys")
    found = runtime.store(wide.drop("keys"), "jaccard-sets")
    classes = runtime.store(found.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "jaccard-classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "n").groupBy("doc_id").agg(F.max("n").alias("n"))
    total = classes.count()
    keyed = wide.select("doc_id", "n", "keys").join(_small(reps.select("doc_id"), total), "doc_id", "left_semi")
    if percent >= RANGES_FROM:
        keyed = keyed.select("doc_id", F.explode("keys").alias("key"))
    else:
        keyed = runtime.store(_rare(keyed, percent), "jaccard-rare")
    groups = components(_candidates(keyed))
    runtime.drop(wide)
    blocks = runtime.store(_blocks(groups, reps, block_tokens), "jaccard-blocks")
    one = blocks.select("comp", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "doc_id")
    leader = blocks.where("blocks > 1").groupBy("comp", "blocks").agg(F.min("doc_id").alias("doc_id"))
    led = leader.select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "doc_id").select("comp", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "doc_id")
    edges = runtime.store(_compare(docs, runtime.store(one.unionByName(led).distinct(), "jaccard-tasks"), size, percent), "jaccard-edges")
    labels = components(edges)

    large = runtime.store(blocks.where("blocks > 1").select("doc_id", "comp"), "jaccard-large")
    if not large.isEmpty():
        edges = edges.unionByName(_across(docs, large, labels, reps, block_tokens, size, percent))
        labels = components(edges)

    named = labels.join(labels.groupBy("label").agg(F.min("id").alias("component_id")), "label").select(F.col("id").alias("rep"), "component_id")
    known = classes.join(named, "rep", "left").select("sig", F.coalesce("component_id", "rep").alias("component_id"))
    out = found.select("doc_id", "n", "sig").join(known, "sig", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"))


def _rare(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, key) of (doc_id, n, keys): the first of a set's shingles, by (documents that have it, hash), without those
    that one set alone has. What a set has alone comes first, so that most sets have nothing else there and are left out.

    ``keys`` are all shingles or what ``counted`` leaves of them: then a shingle behind the lowest part is there only in sets
    of which all of ``keys`` are first, so no order of it matters.
    """
    # A window counts in the one shuffle that a join would need twice; it spills, and a shingle is a small part of any set.
    times = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = rows.select("doc_id", "n", F.size("keys").alias("of"), F.explode("keys").alias("key")).withColumn("times", times).where("times > 1")
    # Sets of one doc_id with so many shingles are taken together, which can only give them more keys.
    held = shared.groupBy("doc_id", "n", "of").agg(F.sort_array(F.collect_set(F.struct("times", "key"))).alias("held"))
    alone = F.col("of") - F.size("held")
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - alone
    return held.where(first > 0).select("doc_id", F.explode(F.slice("held", F.lit(1), first.cast("int"))).alias("k")).select("doc_id", "k.key")


def _all_shingles(docs: DataFrame, large: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, keys) of the sets of large groups: all their shingles."""
    picked = docs.join(_small(large.select("doc_id"), large.count()), "doc_id", "left_semi").select("doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py(), known, size) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in found], pa.int64()), keys], names=["doc_id", "n", "keys"])

    return picked.mapInArrow(run, "doc_id long, n long, keys array<long>")


def _across(docs: DataFrame, large: DataFrame, labels: DataFrame, reps: DataFrame, block_tokens: int, size: int, percent: int) -> DataFrame:
    """Edges across the components that the first pass left inside groups of more than one block."""
    now = labels.select(F.col("id").alias("doc_id"), "label")
    inside = runtime.store(_rare(_all_shingles(docs, large, size), percent), "jaccard-rare").join(now, "doc_id", "left")
    inside = inside.withColumn("label", F.coalesce("label", "doc_id"))
    mixed = inside.join(inside.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "key", "left_semi")
    blocks = runtime.store(_blocks(components(_candidates(mixed.select("doc_id", "key"))), reps, block_tokens), "jaccard-blocks")
    firsts = blocks.select("comp", "doc_id", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    seconds = blocks.where("block > 0").select("comp", "doc_id", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    tasks = runtime.store(firsts.unionByName(seconds).select("comp", "i", "j", "side", "doc_id"), "jaccard-tasks")
    return runtime.store(_compare(docs, tasks, size, percent), "jaccard-edges")

