"""Packing by concatenation: token totals of partitions give global offsets, fixed windows cut the stream.

First pass: each partition tokenizes its rows once and stores, for each row, its number in the partition, the tokens
before it there and its ids (``id_type``: two bytes each do for up to 65,536 entries). Second pass: the totals of the partitions,
one row each, are summed up to a base for each partition; a row's global offset is its base plus the tokens before it,
and windows of ``length`` tokens are cut from that alone, so partitions are cut independently, without a shuffle.
Only the last sequence can be short.

A piece is the part of one document in one window. Boundary records: each piece has its place in the document and
in the window, from which a loader builds attention masks and document ends.

The first pass is stored in the shared folder, which fixes partitions and order: a lost executor repeats reading, not
tokenizing, and repeated work gives the same offsets.

Defined results: a null or empty text is the end token alone; ids may be null or repeat, each row is a document;
an empty table gives an empty table; a text that spans many windows is cut in each; other columns are not looked at.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm import runtime

#: Fixed values of the contract: the length of a sequence and the id after each document.
LENGTH, END = 1024, 0
TOKENIZED = "part long, doc_id long, before long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Partitions whose bases may be broadcast (16 bytes each); with more, the bases are joined by a shuffle.
BROADCAST_PARTITIONS = 1_000_000
_ENCODERS: dict[str, object] = {}
#: White space that the word pattern need not match character by character: its matcher keeps a state for each, and gives
#: up on about a million. The characters that count as white space in the pattern.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


def encoder(path: str, pattern: str, special: dict[str, int]):
    """A byte-level encoder over a rank file. Its ids are those of the tokenizer file with the same vocabulary, special
    tokens in a text included, at several times the speed."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def _ordinary(enc, text: str) -> list[int]:
    """The ids of a text without special tokens. Of a run of white space before a word, the pattern takes all but the last
    character as one piece, and a run at the end whole: long ones are encoded as that piece, what is between them as usual."""
    out, at = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def _encode(enc, text: str, special: dict[str, int]) -> list[int]:
    if not any(s in text for s in special):
        return _ordinary(enc, text)
    out = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text):
        out += [special[part]] if part in special else _ordinary(enc, part)
    return out


def tokenize(df: DataFrame, path: str, pattern: str, special: dict[str, int], id_col: str = "doc_id", text_col: str = "text", id_type: str = "<u2") -> DataFrame:
    """(part, doc_id, before, doc_tokens, ids): ids as numbers of ``id_type``; one that doesn't fit is an error."""
    runtime.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(path, pattern, special), TaskContext.get().partitionId(), 0
        for batch in batches:
            befores, totals, ids = [], [], []
            for text in batch.column(1):
                found = np.array([*_encode(enc, text.as_py() or "", special), END], dtype=id_type)
                befores.append(before)
                totals.append(len(found))
                ids.append(found.tobytes())
                before += len(found)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), batch.column(0), pa.array(befores, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "doc_id", "before", "doc_tokens", "ids"],
            )

    return df.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"CAST(`{text_col}` AS string) AS body").mapInArrow(run, TOKENIZED)


def cut(tokens: DataFrame, length: int = LENGTH, id_type: str = "<u2") -> DataFrame:
    """Pieces of a stored table of ``tokenize``."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the first pass: the window sorts no more than that.
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if totals.count() <= BROADCAST_PARTITIONS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, at, total, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(ids, dtype=id_type).astype("<u4")
                start = 0
                while start < total:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, total - start)
                    crc = zlib.crc32(wide[start : start + size].tobytes())
                    for column, value in zip(out, (doc, start, size, crc, total, sequence, offset), strict=True):
                        column.append(value)
                    start += size
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return placed.mapInArrow(run, PIECES)


def pack(df: DataFrame, path: str, pattern: str, special: dict[str, int], length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", id_type: str = "<u2") -> DataFrame:
    """Packs every row of ``df``; the tokenizer's files must be readable on every executor."""
    return cut(runtime.store(tokenize(df, path, pattern, special, id_col, text_col, id_type), "pack-tokens"), length, id_type)
