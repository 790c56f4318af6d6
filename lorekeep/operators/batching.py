"""Rows in batches that close at either of two limits, as a writer's buffer closes them that takes one row after the other.

Where a batch ends depends on where it began, and so on all rows before; one ordered window over everything would be one task. Here
rows lie in ranges of their order. For a range, all that can come from before is where its first batch ends, one of ``size`` + 1
places; for each of them a range says how many batches close inside it and what is open at its end. A single task passes over
these summaries, not over rows, and tells each range with what it begins. Ranges then number their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.engine.shared import small, store

#: Fixed value: characters at which a batch closes.
CHARACTERS = 2_000_000
#: Rows of a range: one range of their sizes is one task's.
RANGE = 500_000

SUMMARY = "part int, n long, held array<long>, closed array<long>, count array<long>, chars array<long>"
ENTRY = "part int, batch long, count long, chars long"


def _next(held: np.ndarray, size: int, most: int) -> np.ndarray:
    """For a batch that begins at each place, where the next one begins; one more than there are rows if it stays open."""
    n = len(held) - 1
    start = np.arange(n + 1)
    by_count = start + size
    by_chars = np.maximum(np.searchsorted(held, held + most, "left"), start + 1) if most > 0 else np.full(n + 1, n + 1)
    return np.minimum(np.minimum(by_count, by_chars), n + 1)


def summary(chars: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a range's sizes: their sums up to each of the first ``size`` rows, and for a first batch that begins at each of these places the
    batches that close, and rows and characters of the one left open."""
    held = np.concatenate(([0], np.cumsum(chars)))
    n = len(chars)
    after = _next(held, size, most).tolist()
    closed, last = [0] * (n + 2), list(range(n + 2))
    for place in range(n, -1, -1):
        if after[place] <= n:
            closed[place], last[place] = closed[after[place]] + 1, last[after[place]]
    first = min(n, size) + 1
    open_at = np.array(last[:first])
    return held[:first], np.array(closed[:first]), n - open_at, held[n] - held[open_at]


def batched(rows: DataFrame, *order: str, size: int, most: int = CHARACTERS, chars: str = "chars", rows_of_range: int = RANGE) -> DataFrame:
    """``rows`` with ``batch``, from 0 on: in the order of ``order`` a batch takes rows until it has ``size`` or their ``chars`` reach ``most`` (0: no
    such limit). Of rows that tie in all of ``order`` any may come first: name a column that tells them apart. Null sizes are 0."""
    if size < 1 or most < 0:
        raise ValueError(f"batches of {size} rows and {most} characters")
    parts = max(-(-rows.count() // rows_of_range), 1)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    held = store(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", at).withColumn("_chars", F.coalesce(F.col(chars).cast("long"), F.lit(0))), "batch-rows")
    sizes = held.select(F.col("_part").alias("part"), F.col("_at").alias("at"), F.col("_chars").alias("chars"))

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        found = summary(table.sort_by("at")["chars"].to_numpy(), size, most)
        columns = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in found]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([table.num_rows], pa.int64()), *columns], names=[c.split()[0] for c in SUMMARY.split(", ")])

    def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = count = chars = 0
        for batch in batches:
            out = []
            for part, n, held, closed, counts, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append((part, done, count, chars))
                places = range(1, len(held)) if count else range(1)
                first = next((j for j in places if not count or count + j >= size or (most and chars + held[j] >= most)), None)
                if first is None:
                    count, chars = count + n, chars + held[-1]
                else:
                    done, count, chars = done + closed[first] + bool(count), counts[first], left[first]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "batch", "count", "chars"])

    told = store(sizes.groupBy("part").applyInArrow(tell, SUMMARY), "batch-told")
    # One row for each range.
    entries = small(store(told.repartition(1).sortWithinPartitions("part").mapInArrow(passed_on, ENTRY), "batch-entries"))

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        chars = table["chars"].to_numpy()
        done, count, before = (table[c][0].as_py() for c in ("batch", "count", "before"))
        held, n = np.concatenate(([0], np.cumsum(chars))), len(chars)
        cuts = np.zeros(n + 1, np.int64)
        place = 0
        if count:
            place = min(size - count, int(np.searchsorted(held, most - before, "left")) if most else n + 1, n + 1)
            place = max(place, 1)
        after = _next(held, size, most)
        while place <= n:
            if place or count:
                cuts[place] = 1
            place = int(after[place])
        return pa.table({"at": table["at"], "batch": pa.array(done + np.cumsum(cuts)[:n])})

    entered = sizes.join(entries.select("part", "batch", "count", F.col("chars").alias("before")), "part")
    numbered = entered.groupBy("part").applyInArrow(number, "at long, batch long")
    return held.join(numbered.withColumnRenamed("at", "_at"), "_at").select(*rows.columns, "batch")
