"""Minimax contiguous partition of atomic groups into shards (DataFrame functions only).

Rows with equal texts form a group that no cut divides. Groups stand in the order of their SHA-256 digest. The
capacity is the smallest C for which greedy filling (each shard takes groups while it stays within C) needs no
more than ``shards`` shards; it is found by binary search, and the cuts are the greedy ones at that capacity.

Scale: the text is read once, into rows of (id, size, checksum, digest) that are stored in the shared folder.
Sizes are summed by group, then by a digest prefix (a group of copies is summed before the shuffle, so a hot one
costs a row for each task). The driver gets one sum for each of at most 65,536 prefixes. With a greedy run on these
sums from both sides (each cut at the start or at the end of the prefix that holds it), the search leaves a few
prefixes in which a cut can lie; only their sums are split by a longer prefix, again and again, until the sums
are whole groups or few enough to load. The result is exact: every other prefix lies between two cuts as a whole.

Slots number a shard's rows without gaps: rows fall into cells by a hash of their id and their text's checksum,
cells are numbered by a running count, rows inside a cell by a window, so that neither a shard nor a group of copies is sorted in one
task, nor are rows without an id. Only rows that repeat both id and text share a cell.

Defined results: a null text counts as empty, of size 8, in one group with empty texts; null and repeated ids are
rows like any other; an empty table gives an empty table; fewer groups than shards leaves the last shards
empty; input columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm import runtime
from lorekeep.llm import text as T

#: Hex digits of the first prefix and of each longer one, and of a whole digest.
FIRST, STEP, WHOLE = 4, 2, 64
#: Bytes that a row costs besides its text: a fixed value of the contract.
OVERHEAD = 8


@dataclass(frozen=True)
class Unit:
    """What stands between two possible cuts: all groups whose digests begin with ``prefix``, or one group."""

    prefix: str
    size: int
    largest: int
    groups: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or len(self.prefix) == WHOLE


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """For each shard that greedy filling makes, the number of units up to its end; None if ``shards`` don't do."""
    cuts, at = [], 0
    for _ in range(shards):
        upto = bisect_right(ends, at + capacity)
        cuts.append(upto)
        at = ends[upto - 1] if upto else 0
    return cuts if cuts[-1] == len(ends) else None


def _walk(units: list[Unit], ends: list[int], capacity: int, shards: int) -> list[tuple[int, int, int, int]]:
    """For each cut of greedy filling: its least and greatest place, and the first and last unit that can hold it.

    A unit that can be split may end a shard anywhere inside: the least place is before it, the greatest is all of
    the capacity.
    """
    low = high = 0
    out = []
    for _ in range(shards):
        a, b = bisect_right(ends, low + capacity), bisect_right(ends, high + capacity)
        low = ends[a - 1] if a else 0
        if b == len(units) or units[b].atomic:
            high = ends[b - 1] if b else 0
        else:
            high += capacity
        out.append((low, high, a, b))
    return out


def _search(units: list[Unit], ends: list[int], shards: int) -> tuple[int, set[int]]:
    """The smallest capacity that surely does, and the units in which a cut can lie at it or at any smaller one
    that may do; if there are none, it is the smallest of all."""
    total = ends[-1] if ends else 0
    least = max([-(-total // shards), *(u.largest for u in units)], default=0)

    def first(does) -> int:
        low, high = least, max(total, least)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if does(mid) else (mid + 1, high)
        return low

    lower = first(lambda c: _walk(units, ends, c, shards)[-1][1] >= total)
    upper = first(lambda c: _walk(units, ends, c, shards)[-1][0] >= total)
    spans = [(x[2], y[3]) for x, y in zip(_walk(units, ends, lower, shards), _walk(units, ends, upper, shards), strict=True)]
    return upper, {k for a, b in spans for k in range(a, min(b, len(units) - 1) + 1) if not units[k].atomic}


def _ends(units: list[Unit]) -> list[int]:
    return list(accumulate(u.size for u in units))


def minimax_cuts(groups: DataFrame, shards: int, load: int = 200_000) -> tuple[int, list[str]]:
    """The smallest feasible capacity, and for each shard but the last the digest of the first group after it.

    ``groups`` has a row (digest, size) for each group. ``load``: the driver gets at most so many sums at once,
    and at least those of one step.
    """

    def sums(prefix_length: int, within: list[str] | None) -> list[Unit]:
        part = groups
        if within is not None:
            part = part.where(_any(F.substring("digest", 1, n).isin([p for p in within if len(p) == n]) for n in {len(p) for p in within}))
        rows = (
            part.groupBy(F.substring("digest", 1, prefix_length).alias("prefix"))
            .agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups"), F.min("digest").alias("first"))
            .collect()
        )
        return [Unit(r["first"] if r["groups"] == 1 else r["prefix"], r["size"], r["largest"], r["groups"]) for r in rows]

    units = sorted(sums(FIRST, None), key=lambda u: u.prefix)
    length = FIRST
    while True:
        capacity, split = _search(units, _ends(units), shards)
        if not split:
            break
        length = WHOLE if sum(units[k].groups for k in split) <= load else length + STEP
        finer = sums(length, [units[k].prefix for k in split])
        units = sorted([u for k, u in enumerate(units) if k not in split] + finer, key=lambda u: u.prefix)
    cuts = greedy(_ends(units), capacity, shards)
    # "g" stands after every hex digit: no digest reaches it.
    return capacity, [units[c].prefix if c < len(units) else "g" for c in cuts[: shards - 1]]


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def shard_rows(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cells: int = 1024) -> DataFrame:
    """Returns (id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``df``.

    The law is ``bytes``: the largest shard is as small as contiguous whole groups allow. ``cells`` bounds the rows
    that one task numbers: a shard has so many, whatever its groups are.
    """
    body = T.whole(F.col(text_col))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
        F.sha2(body, 256).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col), F.crc32(body)), F.lit(cells)).cast("int").alias("cell"),
    )
    rows = runtime.store(rows, "shard-rows")
    groups = runtime.store(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    _, firsts = minimax_cuts(groups, shards)
    runtime.drop(groups)
    shard = F.lit(0)
    for first in firsts:
        shard = shard + (F.col("digest") >= first).cast("int")
    rows = rows.withColumn("shard", shard)
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each cell of each shard, 24 * 1024 here whatever the input: small enough to broadcast.
    starts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("digest", "id")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "cell"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
