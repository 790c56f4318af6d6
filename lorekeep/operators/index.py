"""A vector index with exact answers: clusters, cut into shells by distance from their centre, which a search skips where the
triangle inequality allows it.

``build`` finds centres on a bounded sample, puts every vector to its nearest centre and cuts each cluster, ordered by
distance from the centre, into blocks of at most ``BLOCK`` rows; it stores the rows, one line for each block (nearest and
farthest distance, rows) and the centres. ``extend`` adds vectors as further blocks under the same centres. However bad
the centres fit, answers stay exact; only the share of blocks that can be skipped falls.

``search`` first reads, for each query, the blocks that its position falls into until they hold k rows, which bounds the distance
of its k-th neighbour; then every block that could hold a nearer row. Blocks are bounded, so a cluster that holds most
vectors, or one vector many times over, is many tasks' work.

Vectors are compared by cosine distance, on the unit sphere, where it is half the square of the straight distance, so the triangle
inequality holds. Distances are rounded to six places and ties go by vec_id, as in ``retrieval.dense_top_k``; bounds leave
``SLACK`` for that. A null vector, or one without a direction (zero or not finite), is nobody's neighbour and finds none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.engine.shared import drop, small, store

#: Vectors that centres are fitted on at most, centres at most, rounds of fitting, and the seed of the sample.
SAMPLE, CENTRES, ROUNDS, SEED = 50_000, 2_048, 8, 17
#: Rows of a block, queries that meet it at a time, and queries that meet it in one group.
BLOCK, QUERIES, MEETING = 8_192, 1_024, 20_000
#: What rounding to six places and the order of additions may change about a cosine distance.
SLACK = 2e-6

ROWS = "centre int, away double, vec_id long, label string, unit array<double>"
SCORED = "query_id long, vec_id long, label string, distance double"


@dataclass
class Index:
    """``rows`` (block, vec_id, label, unit), ``blocks`` (block, centre, nearest, farthest, n), and the centres as a matrix."""

    rows: DataFrame
    blocks: DataFrame
    centres: np.ndarray


def centres_of(vectors: DataFrame, count: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centres by rounds of nearest means over at most ``sample`` vectors; about the square root of all vectors, by default."""
    usable = _units(vectors)
    total = usable.count()
    if total == 0:
        return np.zeros((0, 0))
    share = min(1.0, 1.2 * sample / total)
    rows = usable.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).select("unit").limit(sample).toPandas()["unit"]
    if not len(rows):
        rows = usable.select("unit").limit(sample).toPandas()["unit"]
    points = np.unique(np.array(rows.tolist(), float), axis=0)
    count = min(count or max(1, min(CENTRES, int(total**0.5))), len(points))
    centres = points[np.random.default_rng(SEED).permutation(len(points))[:count]]
    for _ in range(ROUNDS):
        nearest = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(points, -(-len(points) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit) of vectors with a direction."""
    e = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("e"), norm.alias("norm"))
    kept = kept.where((F.col("norm") > 0) & (F.col("norm") < float("inf")) & ~F.isnan("norm"))
    return kept.select("vec_id", "label", F.transform("e", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def build(vectors: DataFrame, centres: np.ndarray | None = None, block: int = BLOCK) -> Index:
    """The index of (vec_id, embedding, label); ids are distinct and not null, embeddings equally long."""
    centres = centres_of(vectors) if centres is None else centres
    rows, blocks = _blocks(vectors, centres, block, "0")
    return Index(rows, blocks, centres)


def extend(index: Index, vectors: DataFrame, name: str, block: int = BLOCK) -> Index:
    """The index with further vectors as blocks of their own, under ``name`` (one that no earlier call had); no row is moved."""
    rows, blocks = _blocks(vectors, index.centres, block, name)
    return Index(index.rows.unionByName(rows), index.blocks.unionByName(blocks), index.centres)


def _blocks(vectors: DataFrame, centres: np.ndarray, block: int, name: str) -> tuple[DataFrame, DataFrame]:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # at most CENTRES rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _matrix(batch.column(2), about.shape[1])
            likeness = units @ about.T
            nearest = np.argmax(likeness, axis=1)
            away = straight(likeness[np.arange(len(units)), nearest])
            yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), pa.array(away), *batch.columns], names=[c.split()[0] for c in ROWS.split(", ")])

    found = _units(vectors).mapInArrow(assign, ROWS)
    ordered = found.repartitionByRange("centre", "away", "vec_id").sortWithinPartitions("centre", "away", "vec_id")
    # Rows of a partition are numbered in order: a block is a run of one cluster's rows between two multiples of its size.
    run = F.shiftrightunsigned(F.monotonically_increasing_id(), 33).cast("string"), F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / block).cast("string")
    rows = store(ordered.withColumn("block", F.concat_ws("/", F.lit(name), *run, F.col("centre").cast("string"))), "index-rows")
    blocks = rows.groupBy("block", "centre").agg(F.min("away").alias("nearest"), F.max("away").alias("farthest"), F.count(F.lit(1)).alias("n"))
    return rows.select("block", "vec_id", "label", "unit"), store(blocks, "index-blocks")


def straight(likeness: np.ndarray) -> np.ndarray:
    """The straight distance of two points of the unit sphere from their scalar product."""
    return np.sqrt(np.maximum(2 - 2 * likeness, 0))


def search(index: Index, queries: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """(query_id, vec_id, label, distance, rank): the nearest ``k`` of each query, exactly. ``queries`` has query_id and query."""
    if not index.centres.size:
        return queries.sparkSession.createDataFrame([], f"{SCORED}, rank int")
    asked, first, found, rest = _passes(index, queries, k, skip_self)
    more = _score(index.rows, rest, asked, k, skip_self)
    return _best(found.select("query_id", "vec_id", "label", "distance").unionByName(more), k)


def share_read(index: Index, queries: DataFrame, k: int) -> float:
    """Of all pairs of a query and a row, the share that a search compares."""
    asked, first, _, rest = _passes(index, queries, k, True)
    sizes = index.blocks.select("block", "n")
    read = first.unionByName(rest).join(small(store(sizes, "index-lines")), "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return read / max(asked.count() * index.rows.count(), 1)


def _passes(index: Index, queries: DataFrame, k: int, skip_self: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The queries, the blocks that each reads first, what was found there, and the blocks to be read after that."""
    renamed = queries.select(F.col("query_id").alias("vec_id"), F.col("query").alias("embedding"), F.lit("").alias("label"))
    asked = store(_units(renamed).select(F.col("vec_id").alias("query_id"), F.col("unit").alias("query")), "index-queries")
    shells = index.blocks.groupBy("centre").agg(F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"), F.sum("n").alias("n"))
    shells = shells.orderBy("centre").toPandas()  # one row for each centre, at most CENTRES
    lines = small(store(index.blocks, "index-lines"))
    least = F.greatest(F.lit(0.0), F.col("away") - F.col("farthest"), F.col("nearest") - F.col("away"))
    # First the blocks nearest by, in the nearest clusters, until they hold k rows and the query itself.
    near = Window.partitionBy("query_id").orderBy(least, "away", "block").rowsBetween(Window.unboundedPreceding, -1)
    around = _clusters(asked.withColumn("reach", F.lit(-1.0)), index.centres, shells, k + 1).join(lines, "centre")
    counted = around.withColumn("before", F.coalesce(F.sum("n").over(near), F.lit(0)))
    first = store(counted.where(F.col("before") <= k).select("query_id", "block"), "index-first")
    found = store(_best(_score(index.rows, first, asked, k, skip_self), k), "index-found")
    # The k-th so far bounds the rest; a query with fewer rows so far reads all.
    kth = found.groupBy("query_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("have"))
    reach = F.when(F.col("have") >= k, F.sqrt(2 * (F.col("kth") + SLACK)) + SLACK)
    bounded = asked.join(kth, "query_id", "left").select("query_id", "query", F.coalesce(reach, F.lit(3.0)).alias("reach"))
    within = _clusters(bounded, index.centres, shells, 0).join(lines, "centre").where(least <= F.col("reach"))
    rest = within.select("query_id", "block").join(first, ["query_id", "block"], "left_anti")
    return asked, first, found, store(rest, "index-rest")


def _clusters(asked: DataFrame, centres: np.ndarray, shells, enough: int) -> DataFrame:
    """(query_id, centre, away, reach) of the clusters to be looked at: the nearest ones until they hold ``enough`` rows, and
    all whose rows can be within ``reach``. Queries meet centres only, by products of matrices; no vector of the index is met."""
    number, nearest, farthest, held = (shells[c].to_numpy() for c in ("centre", "nearest", "farthest", "n"))
    shared = asked.sparkSession.sparkContext.broadcast((centres[number], number, nearest, farthest, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, number, nearest, farthest, held = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                away = straight(_matrix(part.column(1), about.shape[1]) @ about.T)
                least = np.maximum(np.maximum(away - farthest, nearest - away), 0)
                order = np.lexsort((away, least), axis=1)
                before = np.cumsum(held[order], axis=1) - held[order]
                taken = np.zeros(away.shape, bool)
                np.put_along_axis(taken, order, before < enough, 1)
                query, centre = np.nonzero(taken | (least <= part.column(2).to_numpy()[:, None]))
                ids, reach = part.column(0).to_numpy()[query], part.column(2).to_numpy()[query]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(number[centre].astype(np.int32)), pa.array(away[query, centre]), pa.array(reach)], names=["query_id", "centre", "away", "reach"])

    return asked.select("query_id", "query", "reach").mapInArrow(run, "query_id long, centre int, away double, reach double")


def _score(rows: DataFrame, pairs: DataFrame, asked: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The best ``k`` of each block for each query that is paired with it: a product of matrices for a block and some queries. A
    block that more than ``MEETING`` queries look at is met by them in several groups. ``pairs`` is stored."""

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        made: list[pa.RecordBatch] = []
        if block.num_rows and queries.num_rows:
            block = block.sort_by("vec_id")
            width = len(block["unit"][0])
            units, ids, labels = _matrix(block["unit"], width), block["vec_id"].to_numpy(), block["label"].combine_chunks()
            for at in range(0, queries.num_rows, QUERIES):
                part = queries.slice(at, QUERIES)
                distance = np.round(1 - _matrix(part["query"], width) @ units.T, 6)
                asking = part["query_id"].to_numpy()
                if skip_self:
                    distance[asking[:, None] == ids[None, :]] = np.inf
                best = np.argsort(distance, axis=1, kind="stable")[:, :k]  # ties by vec_id
                value = np.take_along_axis(distance, best, 1)
                keep = np.isfinite(value)
                made.append(pa.record_batch([pa.array(np.repeat(asking, keep.sum(axis=1))), pa.array(ids[best[keep]]), labels.take(pa.array(best[keep])), pa.array(value[keep])], names=["query_id", "vec_id", "label", "distance"]))
        return pa.Table.from_batches(made, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()), ("distance", pa.float64())]))

    groups = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("groups"))
    groups = small(store(groups, "index-groups"))
    met = pairs.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups"))).join(asked, "query_id").select("block", "group", "query_id", "query")
    held = rows.join(groups, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1)).alias("group"), "vec_id", "label", "unit")
    return held.groupBy("block", "group").cogroup(met.groupBy("block", "group")).applyInArrow(run, SCORED)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def save(index: Index, root: str) -> None:
    """Writes the index under ``root``: rows by block, lines of blocks, centres."""
    spark = index.rows.sparkSession
    index.rows.write.parquet(f"{root}/rows")
    index.blocks.write.parquet(f"{root}/blocks")
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres)], "centre int, at array<double>")
    centres.coalesce(1).write.parquet(f"{root}/centres")


def load(spark: SparkSession, root: str) -> Index:
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    centres = read("centres").orderBy("centre").select("at").toPandas()["at"]  # at most CENTRES rows
    return Index(read("rows"), read("blocks"), np.array(centres.tolist(), float))


def forget(index: Index) -> None:
    drop(index.rows, index.blocks)
