"""The prefix trie of conversations, as succinct level-order tries of shards that are merged where they meet.

Each conversation is a sequence of turns (role, text); a node is a distinct sequence of first turns. Texts go no further than
the first step: from then on a turn is a label of ``LABEL`` bytes (a digest of its role and text) and its text's size, and a
conversation is the string of its labels.

1. ``sequences``: turns in order, conversations rebuilt, equal ones counted once with the ids that end there. The ids of
   one sequence are joined in ranges first, so a sequence that a third of all conversations share isn't one task's rows.
2. ``shards``: distinct sequences in the order of their labels, cut into ranges of about ``SHARD_TURNS`` turns. Ranges, unlike
   groups by first turn, stay even however many conversations begin alike.
3. For each range numpy builds a trie level by level: a LOUDS bitvector (for each node in level order a one for each child,
   then a zero) with arrays of labels and sizes. Parents are read back from the bitvector, and a walk over the levels
   from the deepest up adds each node's figures to its parent's (``add.at``).
4. The upper nodes that a range shares with its neighbours, those on the path of its first or last sequence as far as the neighbour's
   goes along, are heavy: their partial figures are merged by a grouped sum. Each node counts as new in the first range that has it.

One conversation's labels and sizes (20 bytes a turn) are one task's; nothing else about a key is.

Defined results: rows without a conv_id belong to no conversation and are left out; a null role or text is empty; turns stand in
the order of turn (null first), role, text, so rows that repeat are turns that repeat; the remainder of a negative conv_id
has its sign, as in SQL; an empty table has no node, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm import runtime
from lorekeep.llm.text import whole

#: Bytes of a label, turns of a shard's sequences, ids that are joined into one string at a time.
LABEL, SHARD_TURNS, CHUNK = 16, 250_000, 20_000
#: Fixed values of the contract: conversations go in fives, and take up to eight turns from the first of their five.
FAMILY, BORROWED = 5, 9
#: Rows (of ranges or shared nodes, about 60 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

CHUNKS = "name binary, first_id long, n long, ids string"
ENDS = "name binary, conv_id long, n_convs long, ends_sha256 string"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"
TRIES = "part int, louds binary, labels binary, sizes binary, levels binary"
FIGURES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# --- conversations as sequences of labels


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, labels, sizes): the turns of each conversation, in order, as hex labels and text sizes in bytes."""
    role, text = whole(F.col("role")), whole(F.col("text"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    label = F.left(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256), F.lit(2 * LABEL))
    placed = rows.select("conv_id", place.alias("place"), label.alias("label"), F.octet_length("text").alias("size"))
    turn = F.array_sort(F.collect_list(F.struct("place", "label", "size"))).alias("turns")
    return placed.groupBy("conv_id").agg(turn).select("conv_id", F.col("turns.label").alias("labels"), F.col("turns.size").alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with the first turns of the first of its five instead of its own."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    rows = own.select("*", head.cast("int").alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    cut = lambda c, alias: F.slice(c, 1, BORROWED - 1).alias(alias)
    bases = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), cut("labels", "base_labels"), cut("sizes", "base_sizes"))

    def joined(lent: str, mine: str) -> Column:
        first = F.when(F.col("head") > 0, F.slice(F.coalesce(lent, F.slice(mine, 1, 0)), F.lit(1), F.greatest("head", F.lit(1)))).otherwise(F.slice(mine, 1, 0))
        return F.concat(first, F.slice(mine, F.col("head") + 1, F.greatest(F.size(mine), F.lit(1)))).alias(mine)

    return rows.join(bases, "base", "left").select("conv_id", joined("base_labels", "labels"), joined("base_sizes", "sizes"))


def ended(named: DataFrame) -> DataFrame:
    """(name, conv_id, n_convs, ends_sha256) of (name, conv_id): for each name its least id, their number, and the digest of
    all, ascending and joined by commas. Ranges of ids are joined first; the digest then reads strings, not ids."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        done: list[list] = [[] for _ in range(4)]

        def close() -> None:
            if held:
                for column, value in zip(done, (name, held[0], len(held), ",".join(map(str, held))), strict=True):
                    column.append(value)

        def full() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.utf8())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds, strict=True)], names=["name", "first_id", "n", "ids"])
            for column in done:
                column.clear()
            return out

        for batch in batches:
            for new, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if new != name or len(held) >= CHUNK:
                    close()
                    held, name = [], new
                held.append(conv)
            if done[0]:
                yield full()
        close()
        yield full()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = least = state = None
        count = 0
        for batch in batches:
            out = []
            for new, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if new != name:
                    if name is not None:
                        out.append((name, least, count, state.hexdigest()))
                    name, least, count, state = new, first, 0, hashlib.sha256()
                elif count:
                    state.update(b",")
                state.update(ids.encode())
                count += n
            yield _rows(out)
        yield _rows([] if name is None else [(name, least, count, state.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.utf8())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["name", "conv_id", "n_convs", "ends_sha256"])

    ranged = named.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(chunks, CHUNKS)
    return ranged.repartition("name").sortWithinPartitions("name", "first_id").mapInArrow(digests, ENDS)


def sequences(turns: DataFrame) -> DataFrame:
    """(seq, sizes, conv_id, n_convs, ends_sha256) of each distinct rebuilt sequence: its labels' bytes, the sizes of its texts,
    and what ``ended`` says of its conversations. Stored."""
    runtime.ship(turns.sparkSession)
    own = runtime.store(ordered(turns), "trie-own")
    seq = F.unhex(F.array_join("labels", ""))
    all_rows = rebuilt(own).select("conv_id", seq.alias("seq"), "sizes")
    named = runtime.store(all_rows.withColumn("name", F.unhex(F.left(F.sha2("seq", 256), F.lit(2 * LABEL)))), "trie-rebuilt")
    runtime.drop(own)
    found = runtime.store(named.select("name", "seq", "sizes", "conv_id").join(ended(named), ["name", "conv_id"]).drop("name"), "trie-sequences")
    runtime.drop(named)
    return found


def shards(found: DataFrame, turns: int = SHARD_TURNS) -> DataFrame:
    """Adds ``part``, the number of the range of each sequence, and what the range shares with its neighbours: ``with_before`` and
    ``with_next``, the labels that its first and last sequence have in common with the nearest ones outside (-1: there is none)."""
    total = found.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    parts = -(-total // turns) or 1
    ranged = runtime.store(found.repartitionByRange(parts, "seq").withColumn("part", F.spark_partition_id()), "trie-ranges")
    # One row for each range: the window sorts no more than that.
    near = Window.orderBy("part")
    ends = ranged.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    ends = ends.select("part", _common(F.col("first"), F.lag("last").over(near)).alias("with_before"), _common(F.col("last"), F.lead("first").over(near)).alias("with_next"))
    return ranged.join(F.broadcast(ends) if parts <= BROADCAST_ROWS else ends, "part")


def _common(a: Column, b: Column) -> Column:
    """How many labels two sequences have in common at their beginning; -1 if the second is null."""
    most = F.least(F.octet_length(a), F.octet_length(b)) / LABEL
    piece = lambda s, k: s.substr((k - 1) * LABEL + 1, F.lit(LABEL))
    same = F.transform(F.sequence(F.lit(1), most.cast("int")), lambda k: piece(a, k) == piece(b, k))
    differs = F.array_position(same, False)
    return F.when(b.isNull(), -1).when(most == 0, 0).when(differs == 0, most).otherwise(differs - 1).cast("int")


# --- tries of a shard


@dataclass
class Trie:
    """A trie in level order; node 0 is the root. ``louds``: for each node a one for each child, then a zero, packed into bytes.
    ``labels`` has two numbers for each node but the root, ``sizes`` one for each; ``levels`` says where each level begins."""

    louds: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    levels: np.ndarray

    def __len__(self) -> int:
        return int(self.levels[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.louds, count=2 * len(self) - 1)

    def parents(self) -> np.ndarray:
        """The parent of each node (the root: -1): the zeros before the one that stands for it."""
        bits = self.bits()
        return np.concatenate(([-1], np.cumsum(bits == 0)[bits == 1]))

    def degrees(self) -> np.ndarray:
        """The ones between two zeros."""
        return np.diff(np.flatnonzero(self.bits() == 0), prepend=-1) - 1

    def up(self, *figures: np.ndarray) -> None:
        """Adds to each node what its subtree has, from the deepest level up."""
        parents = self.parents()
        for level in range(len(self.levels) - 2, 0, -1):
            nodes = slice(self.levels[level], self.levels[level + 1])
            for x in figures:
                np.add.at(x, parents[nodes], x[nodes])

    def up_least(self, x: np.ndarray) -> None:
        parents = self.parents()
        for level in range(len(self.levels) - 2, 0, -1):
            nodes = slice(self.levels[level], self.levels[level + 1])
            np.minimum.at(x, parents[nodes], x[nodes])


def build(seqs: list[bytes], sizes: list[np.ndarray]) -> tuple[Trie, np.ndarray]:
    """The trie of sorted distinct sequences, and the node at which each ends."""
    labels = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, 2)
    all_sizes = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
    lengths = np.array([len(s) // LABEL for s in seqs], np.int64)
    begin = np.cumsum(lengths) - lengths
    ends = np.zeros(len(seqs), np.int64)
    node = np.zeros(len(seqs), np.int64)  # of each sequence, at the level reached
    active = np.arange(len(seqs))
    levels, degrees, kept = [0, 1], [], []
    while True:
        depth = len(levels) - 2
        ends[active[lengths[active] == depth]] = node[active[lengths[active] == depth]]
        active = active[lengths[active] > depth]
        at = begin[active] + depth
        fresh = np.ones(len(active), bool)
        fresh[1:] = (node[active][1:] != node[active][:-1]) | (labels[at[1:]] != labels[at[:-1]]).any(axis=1)
        degree = np.zeros(levels[-1] - levels[-2], np.int64)
        np.add.at(degree, node[active[fresh]] - levels[-2], 1)
        degrees.append(degree)
        if not len(active):
            break
        node[active] = levels[-1] + np.cumsum(fresh) - 1
        kept.append(at[fresh])
        levels.append(levels[-1] + int(fresh.sum()))
    places = np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64)
    degree = np.concatenate(degrees)
    bits = np.ones(int(degree.sum()) + len(degree), np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return Trie(np.packbits(bits), labels[places], np.concatenate(([0], all_sizes[places])), np.array(levels)), ends


def path_keys(seq: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` labels of a sequence: names of nodes that hold in all shards."""
    state, out = hashlib.sha256(), [hashlib.sha256().digest()[:LABEL]]
    for k in range(depth):
        state.update(seq[k * LABEL : (k + 1) * LABEL])
        out.append(state.copy().digest()[:LABEL])
    return out


def roll_up(trie: Trie, seqs: list[bytes], ends: np.ndarray, least: np.ndarray, count: np.ndarray, with_before: int, with_next: int) -> dict[str, np.ndarray]:
    """The figures of a shard's nodes; those of shared nodes are parts of sums. Nodes that an earlier shard has too are not
    new here: as children, and in the bytes that one copy of each node needs, they count there."""
    size, parents, degrees = len(trie), trie.parents(), trie.degrees()
    depth = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
    first = trie.levels[: with_before + 1]  # the first nodes of the levels: the path of the first sequence
    new = np.ones(size, np.int64)
    new[first] = 0
    convs = np.zeros(size, np.int64)
    convs[ends] = count
    conv = np.full(size, np.iinfo(np.int64).max)
    conv[ends] = least
    leaves = (degrees == 0).astype(np.int64)
    if with_next == len(seqs[-1]) // LABEL:
        leaves[ends[-1]] = 0  # the next shard begins below it
    trie.up_least(conv)
    trie.up(convs, leaves)
    saved = (convs - new) * trie.sizes
    trie.up(saved)
    children = degrees.copy()
    np.subtract.at(children, parents[first[1:]], 1)
    keys = np.full(size, None, object)
    last = trie.levels[1 : with_next + 2] - 1
    for nodes, names in ((first, path_keys(seqs[0], with_before)), (last, path_keys(seqs[-1], with_next))):
        for node, name in zip(nodes.tolist(), names, strict=False):
            keys[node] = name
    return {"conv_id": conv, "depth": depth, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "key": keys, "parents": parents}


def _sorted(table: pa.Table) -> tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray, list[str]]:
    table = table.sort_by("seq")
    return table["seq"].to_pylist(), [np.array(s.as_py(), np.int64) for s in table["sizes"]], table["conv_id"].to_numpy(), table["n_convs"].to_numpy(), table["ends_sha256"].to_pylist()


def tries(parts: DataFrame) -> DataFrame:
    """(part, louds, labels, sizes, levels): the trie of each range of ``shards`` as bytes (labels big-endian, others int64)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        seqs, sizes, *_ = _sorted(table)
        trie, _ = build(seqs, sizes)
        columns = (trie.louds, trie.labels.astype(">u8"), trie.sizes, trie.levels.astype(np.int64))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())} | {n: pa.array([c.tobytes()], pa.binary()) for n, c in zip(("louds", "labels", "sizes", "levels"), columns, strict=True)})

    return parts.groupBy("part").applyInArrow(run, TRIES)


def shard_nodes(parts: DataFrame) -> DataFrame:
    """The nodes of all ranges. A node with a ``key`` is shared: its figures are a range's part of sums. ``parent_conv_id`` is null
    where the parent has a ``parent_key`` instead, or for the root."""

    def run(table: pa.Table) -> pa.Table:
        seqs, sizes, least, count, digests = _sorted(table)
        trie, ends = build(seqs, sizes)
        found = roll_up(trie, seqs, ends, least, count, table["with_before"][0].as_py(), table["with_next"][0].as_py())
        parents, keys = found.pop("parents"), found["key"]
        above = np.maximum(parents, 0)
        parent_key = np.where(parents >= 0, keys[above], None)
        hidden = (parents < 0) | np.array([k is not None for k in parent_key])
        named = np.full(len(trie), None, object)
        named[ends] = digests
        columns = {k: pa.array(found[k]) for k in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")}
        columns |= {"parent_conv_id": pa.array(found["conv_id"][above], mask=hidden), "ends_sha256": pa.array(named, pa.utf8())}
        columns |= {"key": pa.array(keys, pa.binary()), "parent_key": pa.array(parent_key, pa.binary())}
        return pa.table([columns[c.split()[0]] for c in NODES.split(", ")], names=[c.split()[0] for c in NODES.split(", ")])

    return parts.groupBy("part").applyInArrow(run, NODES)


def merged(nodes: DataFrame) -> DataFrame:
    """All nodes once: those of one range as they are, shared ones summed up over ranges and joined to their parents by key.
    ``nodes`` is stored."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = nodes.where("key IS NOT NULL").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("parent_key").alias("parent_key"))
    shared = runtime.store(shared, "trie-shared")
    names = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    own = nodes.where("key IS NULL")
    below = own.where("parent_key IS NOT NULL").drop("parent_conv_id").join(names, "parent_key")
    upper = shared.where("parent_key IS NOT NULL").join(names, "parent_key")
    root = shared.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    rows = own.where("parent_key IS NULL").select(*FIGURES)
    for part in (below, upper, root):
        rows = rows.unionByName(part.select(*FIGURES))
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations in ``turns`` (conv_id, turn, role, text)."""
    found = sequences(turns)
    return merged(runtime.store(shard_nodes(shards(found, shard_turns)), "trie-nodes"))
