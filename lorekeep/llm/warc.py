"""Merkle fixity audit of web archive records.

A record is written as a WARC response (header lines, payload, two line ends) and hashed with SHA-256; its offset is its
place in the file that holds its range of keys. Trees stand over ordered ranges of keys: a node of level L covers
FANOUT ** L of them, and its hash is that of its children's numbers and hashes in order; a key is the lowest level. Levels
are added until a replica's last one has at most FANOUT nodes, over which its root stands. Two replicas
are compared by their roots, then only below nodes that differ, level by level, down to the keys; only
records of those are read again. Keys rather than places bound the ranges, so that a lost record
doesn't shift the ranges after it.

Scale: only (key, length, digest) leave the scan, and each level has a fraction of the rows below. A key that many
records share is summed before the shuffle (a count, and sums of its digests, which don't depend on order); a node has
FANOUT children at most. Offsets are running sums in two steps, over cells of a file (its keys, and in each the records by
the first digits of their digests) and inside a cell, so that a key that very many records share is dealt to CELLS tasks.

Defined results: null urls and payloads count as empty; a null key is a key of its own, in a file of its own (null) and
different from every number, negative ones included; repeated equal records count, so one copy too
few is found; every record that differs is a row, also of those that share a key; identical replicas give an empty
result, as do two empty ones; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm import runtime

#: Children of a node, and keys whose records share a file, as powers of two (whole numbers of any size are shifted exactly);
#: hex digits that deal a key's records to cells.
FANOUT_BITS, FILE_BITS, CELL_DIGITS = 4, 12, 3
FANOUT, FILE_KEYS = 1 << FANOUT_BITS, 1 << FILE_BITS
#: Nodes (16 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Equal copies that are made rows at once.
COPIES = 4096


def record_bytes(url: Column, payload: Column) -> Column:
    """The record as it stands in a WARC file."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    head = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ", "\r\nContent-Type: text/html\r\nContent-Length: ", "\r\n\r\n", "\r\n\r\n")
    return F.concat(F.lit(head[0]), F.coalesce(url, F.lit("")), F.lit(head[1]), F.octet_length(body).cast("string"), F.lit(head[2]), body, F.lit(head[3]))


def records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(key, length, digest) of each record, stored: both replicas are read once."""
    whole = record_bytes(F.col(url), F.col(payload))
    rows = df.select(F.col(key).cast("long").alias("key"), whole.alias("whole"))
    return runtime.store(rows.select("key", F.octet_length("whole").cast("long").alias("length"), F.sha2("whole", 256).alias("digest")), "warc-records")


def keys(found: DataFrame) -> DataFrame:
    """(node, hash) of the lowest level. Digests are summed in four parts, so that order doesn't matter."""
    part = lambda k: F.sum(F.conv(F.substring("digest", 16 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}")
    summed = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), *(part(k) for k in range(4)))
    return summed.select(F.col("key").alias("node"), F.sha2(F.concat_ws(":", "n", "bytes", "s0", "s1", "s2", "s3"), 256).alias("hash"))


def level_up(nodes: DataFrame) -> DataFrame:
    children = F.sort_array(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), "\n")
    return nodes.groupBy(_up(F.col("node")).alias("up")).agg(F.sha2(text, 256).alias("hash")).withColumnRenamed("up", "node")


def _up(node: Column) -> Column:
    """The number of a node's parent; null stands above null."""
    return F.shiftright(node, FANOUT_BITS)


def trees(*replicas: DataFrame) -> list[list[DataFrame]]:
    """The levels of each replica's tree, keys first, the last of at most FANOUT nodes each; all have the same number
    of levels, and each level is stored."""
    out = [[runtime.store(keys(r), "warc-level")] for r in replicas]
    while any(levels[-1].count() > FANOUT for levels in out):
        for levels in out:
            levels.append(runtime.store(level_up(levels[-1]), "warc-level"))
    return out


def root(levels: list[DataFrame]) -> str:
    """The hash over the last level's nodes in order, which are at most FANOUT."""
    top = sorted(((r["node"] is not None, r["node"] or 0, r["hash"]) for r in levels[-1].collect()))
    return hashlib.sha256(repr(top).encode()).hexdigest()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def differing_keys(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """The keys below differing roots, found by descent: a level is only looked at below nodes that differ, and none if the
    roots are equal."""
    if root(a) == root(b):
        return a[0].select(F.col("node").alias("key")).limit(0)
    wrong: DataFrame | None = None
    for left, right in zip(reversed(a), reversed(b), strict=True):
        if wrong is not None:
            below = _small(wrong.select(F.col("node").alias("up")))
            left, right = (x.join(below, _up(F.col("node")).eqNullSafe(F.col("up")), "left_semi") for x in (left, right))
        both = left.join(right.select(F.col("node").alias("beside"), F.col("hash").alias("other")), F.col("node").eqNullSafe(F.col("beside")), "full_outer")
        found = both.where(~F.col("hash").eqNullSafe(F.col("other"))).select(F.coalesce("node", "beside").alias("node"))
        upper, wrong = wrong, runtime.store(found, "warc-wrong")
        if upper is not None:
            runtime.drop(upper)
    return wrong.withColumnRenamed("node", "key")


def audit(left: DataFrame, right: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Returns (key, status, file_id, record_offset, length, digest_a, digest_b), one row for each record that differs.

    ``missing``: the right replica lacks it, ``extra``: only the right has it; of a record with several equal copies, one
    row for each copy too few or too many. ``corrupt``: both replicas have one record of the key, and they differ; where
    more share the key, nothing tells which became which, so each is missing or extra. Offset and length are the left's
    record's in its file (of equal copies, the first ones'); null for extra ones."""
    a, b = records(left, key, url, payload), records(right, key, url, payload)
    built = trees(a, b)
    wrong = _small(differing_keys(*built))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = a.select("key", "length", "digest", one.alias("a"), none.alias("b")).unionByName(b.select("key", "length", "digest", none.alias("a"), one.alias("b")))
    counted = _where_in(both, wrong, "key").groupBy("key", "length", "digest").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counted = runtime.store(counted, "warc-counted")
    for level in (*built[0], *built[1]):
        runtime.drop(level)
    # One record on each side, and the key differs: the one became the other.
    side = lambda k: F.min(F.when(F.col(k) > 0, F.col("digest"))).alias(f"digest_{k}")
    pairs = counted.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), side("a"), side("b")).where("a = 1 AND b = 1")
    pairs = runtime.store(pairs.select("key", F.lit("corrupt").alias("status"), "digest_a", "digest_b", none.alias("copy")), "warc-pairs")
    more = F.col("a") - F.col("b")
    rest = _where_in(counted.where("a <> b"), _small(pairs.select("key")), "key", "left_anti")
    # A row for each copy, in two steps, so that no array holds a number for each of very many.
    rest = rest.withColumn("more", F.abs(more)).withColumn("block", F.explode(F.sequence(none, F.floor((F.col("more") - 1) / COPIES))))
    rest = rest.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("more"), (F.col("block") + 1) * COPIES) - 1)))
    rest = rest.select("key", F.when(more > 0, "missing").otherwise("extra").alias("status"), F.when(more > 0, F.col("digest")).alias("digest_a"), F.when(more < 0, F.col("digest")).alias("digest_b"), "copy")
    located = pairs.unionByName(rest).withColumn("file_id", F.shiftright("key", FILE_BITS))
    out = _located(located, _offsets(a, located))
    return out.select(F.col("key").alias(key), "status", "file_id", "record_offset", "length", "digest_a", "digest_b")


def _where_in(df: DataFrame, some: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``column``, null or not, is (or isn't) in ``some``, which has no other column."""
    return df.join(some.withColumnRenamed(column, "__in"), F.col(column).eqNullSafe(F.col("__in")), how)


def _offsets(found: DataFrame, located: DataFrame) -> DataFrame:
    """(at_key, at_digest, first, length) of the records in files with something to report: where the first of equal copies begins."""
    files = _small(located.select("file_id").distinct())
    placed = _where_in(found.withColumn("file_id", F.shiftright("key", FILE_BITS)), files, "file_id")
    # Equal copies are one row from here on.
    placed = placed.groupBy("file_id", "key", "digest").agg(F.sum("length").alias("bytes"), F.first("length").alias("length"))
    placed = runtime.store(placed.withColumn("cell", F.substring("digest", 1, CELL_DIGITS)), "warc-placed")
    earlier = Window.partitionBy("file_id").orderBy("key", "cell").rowsBetween(Window.unboundedPreceding, -1)
    # A file has a cell for each key, and more only for keys that records share: what one task sums up is bounded.
    cells = placed.groupBy("file_id", "key", "cell").agg(F.sum("bytes").alias("bytes"))
    cells = cells.select("file_id", F.col("key").alias("cell_key"), F.col("cell").alias("in_cell"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "cell").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    both = placed.join(cells.drop("file_id"), F.col("key").eqNullSafe(F.col("cell_key")) & (F.col("cell") == F.col("in_cell")))
    return both.select(F.col("key").alias("at_key"), F.col("digest").alias("at_digest"), (F.col("start") + F.col("inside")).alias("first"), "length")


def _located(located: DataFrame, offsets: DataFrame) -> DataFrame:
    same = F.col("key").eqNullSafe(F.col("at_key")) & (F.col("digest_a") == F.col("at_digest"))
    return located.join(offsets, same, "left").withColumn("record_offset", F.col("first") + F.col("copy") * F.col("length"))


def damaged(df: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """A replica with known faults, chosen by the payloads' hashes: of 256 records about one has its last character
    changed, one is lost and one appears once more under another key."""
    tag = F.substring(F.sha2(F.coalesce(F.col(payload), F.lit("")), 256), 1, 2)
    kept = df.where(tag != "01").withColumn(payload, F.when(tag == "00", F.concat(F.substr(F.col(payload), F.lit(1), F.length(payload) - 1), F.lit("\u0000"))).otherwise(F.col(payload)))
    return kept.unionByName(df.where(tag == "02").withColumn(key, F.col(key) + F.lit(1 << 40)))
