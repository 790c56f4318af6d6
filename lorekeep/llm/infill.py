"""Fill-in-the-middle transformation by whole-batch numpy kernels on Arrow's UTF-8 buffers.

A text is a run of units; two cuts part it into prefix, middle and suffix, which are written in another order behind
sentinels. A kernel works on the bytes of many texts at once, without building a string for any of them: a table
gives each byte its class; a matrix of the classes of adjacent bytes says where a unit begins; a cumulative sum of
those places, reset at each text, numbers the units; ``searchsorted`` in that sum finds the bytes of all cuts
together; and the output is gathered from spans of the source. A batch is cut into slices of at most ``SLICE`` bytes
(one longer text is a slice of its own), so a task's memory doesn't depend on the size of a batch.

Units are code points (``UNITS["codepoint"]``) or runs of one class of bytes (``UNITS["run"]``: letters and digits with
all bytes beyond ASCII, blanks, other signs).

What is drawn for a row depends on its id alone: the first four 32-bit groups of the SHA-256 of ``1:`` and the decimal
id. The first two, modulo the number of units plus one, are the cuts, the third keeps a share of texts plain, the fourth
chooses the order of the parts. A text that is empty or holds a sentinel stays plain, so ``restore`` gets each text back
from its output and form: sentinels can't arise where parts meet, as they begin with ``<``, end with ``>`` and hold
neither in between.

Defined results: a null text is empty; rows with a null id draw as if it had no digits; ids may repeat; rows of a table
that repeat give equal rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import runtime
from lorekeep.llm.text import whole

#: Fixed values of the contract: the sentinels, of 100 texts those that are not plain, and of those in 100 the ones with the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
SIGN = 3  # bytes of a sentinel
SLICE = 4 << 20
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
RESTORED = "doc_id long, form string, text string"

#: Classes of bytes: one that goes on with a character, blanks, other signs of ASCII, and all that words are made of.
ON, BLANK, OTHER, WORD = range(4)


def _classes() -> np.ndarray:
    table = np.full(256, WORD, np.uint8)
    table[0x80:0xC0] = ON
    table[:0x80] = [BLANK if chr(b) in " \t\n\v\f\r" else WORD if chr(b).isalnum() else OTHER for b in range(0x80)]
    return table


def _begins(differ: bool) -> np.ndarray:
    """[class of a byte, class of the next]: whether a unit begins at the next. Words may end within a character's bytes."""
    grid = np.ones((4, 4), bool)
    if differ:
        grid = ~np.eye(4, dtype=bool)
        grid[ON, WORD] = False
    grid[:, ON] = False
    return grid


CLASSES = _classes()
UNITS = {"codepoint": _begins(False), "run": _begins(True)}


def bodies(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binary values, and where each value begins; one entry more says where the last ends."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Rows (from, to) of slices that hold at most ``most`` bytes, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        yield at, to
        at = to


def unit_starts(body: np.ndarray, offsets: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin in all bytes, and for each text how many units begin before it (one entry more: in all)."""
    kinds = CLASSES[body]
    begins = np.ones(len(body), bool)
    begins[1:] = units[kinds[:-1], kinds[1:]]
    begins[offsets[:-1][offsets[:-1] < len(body)]] = True
    return begins, np.concatenate(([0], np.cumsum(begins)))[offsets]


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of spans of ``source``, one after the other."""
    kind = np.int32 if max(len(source), int(lengths.sum())) < 1 << 31 else np.int64
    shift = (starts - (np.cumsum(lengths) - lengths)).astype(kind)
    places = np.repeat(shift, lengths)
    places += np.arange(len(places), dtype=kind)
    return source[places]


def sentinels(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sentinels stand in all bytes, and the row of each."""
    at = np.flatnonzero(body[: max(len(body) - SIGN + 1, 0)] == PREFIX[0])
    at = at[(body[at + 2] == PREFIX[2]) & np.isin(body[at + 1], np.frombuffer(PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2], np.uint8))]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + SIGN <= offsets[row + 1]
    return at[inside], row[inside]


def arrange(body: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, form, prefix units, middle units, output bytes, output offsets) of texts; ``drawn`` has four numbers for each."""
    begins, before = unit_starts(body, offsets, units)
    n = np.diff(before)
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    form = np.where(drawn[:, 2] % 100 >= TRANSFORMED, PLAIN, np.where(drawn[:, 3] % 100 < SUFFIX_FIRST, SPM, PSM))
    form[n == 0] = PLAIN
    form[sentinels(body, offsets)[1]] = PLAIN
    # The byte at which unit number k of all begins: the first place where the running count of beginnings reaches k + 1.
    count = np.cumsum(begins)
    byte = lambda unit: np.where(unit >= n, offsets[1:], np.searchsorted(count, before[:-1] + unit + 1))
    start, end = offsets[:-1], offsets[1:]
    first, second = byte(low), byte(high)
    signs = len(body)  # the sentinels stand behind the texts in the source of the output
    size = end - start
    k = len(n)
    starts, lengths = np.zeros((k, 6), np.int64), np.zeros((k, 6), np.int64)
    starts[:, 0], lengths[:, 0] = start, size
    parts = {"P": (start, first - start), "M": (first, second - first), "S": (second, end - second)}
    for kind, order in ((PSM, "PSM"), (SPM, "SPM")):
        rows = form == kind
        for place, part in enumerate(order):
            starts[rows, 2 * place], lengths[rows, 2 * place] = signs + SIGN * "PSM".index(part), SIGN
            starts[rows, 2 * place + 1], lengths[rows, 2 * place + 1] = (x[rows] for x in parts[part])
    out = gather(np.concatenate((body, np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8))), starts.ravel(), lengths.ravel())
    return n, form, low, high - low, out, np.concatenate(([0], np.cumsum(lengths.sum(axis=1))))


def rearrange(body: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts whose outputs and forms are given."""
    at, row = sentinels(body, offsets)
    keep = form[row] != PLAIN
    at, row = at[keep], row[keep]
    moved = np.flatnonzero(form != PLAIN)
    if len(at) != 3 * len(moved) or not np.array_equal(row, np.repeat(moved, 3)):
        raise ValueError("an output that isn't plain must hold three sentinels")
    at = at.reshape(-1, 3)
    want = np.where((form[moved] == PSM)[:, None], np.frombuffer(b"PSM", np.uint8), np.frombuffer(b"SPM", np.uint8))
    if not (np.array_equal(body[at + 1], want) and np.array_equal(at[:, 0], offsets[moved])):
        raise ValueError("the sentinels of an output don't stand in the order of its form")
    k = len(form)
    starts, lengths = np.zeros((k, 3), np.int64), np.zeros((k, 3), np.int64)
    starts[:, 0], lengths[:, 0] = offsets[:-1], np.diff(offsets)
    ends = np.column_stack((at[:, 1:], offsets[moved + 1]))
    swap = form[moved] == SPM  # the prefix is the second part
    for place, source in enumerate((np.where(swap, 1, 0), np.full(len(moved), 2), np.where(swap, 0, 1))):
        begin = np.take_along_axis(at, source[:, None], 1)[:, 0] + SIGN
        starts[moved, place] = begin
        lengths[moved, place] = np.take_along_axis(ends, source[:, None], 1)[:, 0] - begin
    return gather(body, starts.ravel(), lengths.ravel()), np.concatenate(([0], np.cumsum(lengths.sum(axis=1))))


def _strings(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    made = pa.Array.from_buffers(pa.large_utf8(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    return made.cast(pa.utf8()) if len(body) < 1 << 31 else made


def transform(df: DataFrame, units: str = "codepoint", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row: units of the text, of prefix and of middle (null
    where the form is plain), and the new text."""
    runtime.ship(df.sparkSession)
    grid = UNITS[units]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(-1, 8)[:, :4].astype(np.int64)
            body, offsets = bodies(batch.column(1))
            for a, b in slices(offsets):
                n, form, low, middle, out, ends = arrange(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], drawn[a:b], grid)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(np.array(FORMS, object)[form], pa.utf8()), pa.array(low, mask=plain), pa.array(middle, mask=plain), _strings(out, ends)],
                    names=[x.split()[0] for x in MADE.split(", ")],
                )

    doc = F.col(f"`{id_col}`").cast("long")
    seed = F.unhex(F.sha2(F.concat(F.lit("1:"), F.coalesce(doc.cast("string"), F.lit(""))), 256))
    return df.select(doc.alias("doc_id"), whole(F.col(f"`{text_col}`")).cast("binary").alias("body"), seed.alias("seed")).mapInArrow(run, MADE)


def restore(made: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, form, text) of rows of ``transform``, from output and form alone; columns named in ``keep`` come along."""
    runtime.ship(made.sparkSession)
    schema = RESTORED + "".join(f", `{c}` {made.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = np.array([FORMS.index(x) for x in batch.column(1).to_pylist()], np.int64)
            body, offsets = bodies(batch.column(2))
            for a, b in slices(offsets):
                text, ends = rearrange(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], form[a:b])
                rest = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([rest[0], rest[1], _strings(text, ends), *rest[3:]], names=["doc_id", "form", "text", *keep])

    return made.select("doc_id", "form", F.col("output").cast("binary").alias("body"), *keep).mapInArrow(run, schema)


def digest_columns(made: DataFrame) -> DataFrame:
    """Rows of ``transform`` with digests instead of texts: of the output, and of what ``restore`` makes of it."""
    kept = made.withColumn("output_sha256", F.sha2(F.col("output"), 256))
    names = ("n", "prefix_chars", "middle_chars", "output_sha256")
    back = restore(kept, *names)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("text"), 256).alias("restored_sha256"))
