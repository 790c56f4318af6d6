"""SentencePiece encoding and decoding by exact backtracking over longest matches.

A merge-type model joins, again and again, the two neighbours whose joint piece scores best, the leftmost of equals. Its
result is the one sequence of pieces in which no two neighbours would have been joined otherwise (van Antwerpen and Neubeck,
"So many tokens, so little time", 2024), so it can be found without merging: take the longest piece at each place, and

- accept it if it stands unchanged beside the piece before it, which ``compatible`` decides by undoing the merges of both,
  the last one first, and looking at each step whether the two symbols at the border would have been joined by then;
- else try the next shorter piece there; if none is left, mark the place in a bitfield of failed positions, drop the piece
  before and try its next shorter one. A failed position is never entered again, so work is linear in the text.

The longest pieces at all places come from one pass of an Aho-Corasick automaton of the reversed pieces over the reversed
text. Characters that no piece holds stand alone, as bytes if the model has byte pieces.

Texts are first cut where no piece can reach across (``Model.unit``), which changes no result; the ids of short units are
remembered up to a fixed number; then those that were not asked for of late are forgotten.

Needs a model of the merge type whose pieces score no better than the pieces they are made of, without pieces defined by
users and with texts left as they are but for blanks (``Model`` checks what the library tells). Surrogates can't be in Spark's
strings. The library itself reads the model's file, nothing else.

Defined results: a null text is empty and has the end id alone; ids may be null or repeat; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import runtime

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, text string"
#: How the format writes a blank, and what its library writes for an unknown piece and for a byte that isn't UTF-8.
SPACE, UNKNOWN, BROKEN = "▁", " ⁇ ", "�"
#: Units of text that a worker remembers, and the characters of the longest of them; pairs of pieces whose fit it remembers.
REMEMBERED, LONG, PAIRS = 400_000, 48, 500_000
#: Characters of texts decoded or encoded before a batch of results leaves a task.
BATCH = 4 << 20
_MODELS: dict[str, Model] = {}
_KNOWN: dict[str, Remembered] = {}


class Model:
    """Tables of one model. Pieces go by their strings; ``rank`` orders merges: the least is made first, single characters are 0."""

    def __init__(self, path: str):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end, self.unknown = source.eos_id(), source.unk_id()
        numbers = range(source.get_piece_size())
        self.bytes = {int(source.id_to_piece(i)[1:-1], 16): i for i in numbers if source.is_byte(i)}
        silent = {i for i in numbers if source.is_control(i)}
        plain = [i for i in numbers if not (i in silent or source.is_byte(i) or source.is_unknown(i) or source.is_unused(i))]
        self.ids = {source.id_to_piece(i): i for i in plain}
        scores = {source.id_to_piece(i): source.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted({s for p, s in scores.items() if len(p) > 1}, reverse=True), 1)}
        self.rank = {p: order[s] for p, s in scores.items() if len(p) > 1}
        self.split = {p: found for p in self.rank if (found := self._last_merge(p)) is not None}
        self._check(source)
        self.single = {p for p in self.ids if len(p) == 1}
        own = {p for p in self.ids if len(p) == 1 or p in self.split}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in own), None) for p in own}
        self.automaton = ahocorasick.Automaton()
        for piece in own:
            self.automaton.add_word(piece[::-1], piece)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.unit = self._units()
        self._surface(numbers, silent, source)

    def _check(self, source) -> None:
        for piece, (left, right) in self.split.items():
            if max(self.rank.get(left, 0), self.rank.get(right, 0)) > self.rank[piece]:
                raise ValueError(f"{piece!r} scores better than its parts")
        probe = "  \ufb01 \u2460\t\u00a0A  "
        if source.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model must leave texts as they are, but for a blank in front and the sign for blanks")

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging; only used on single pieces, to find how they are made."""
        while True:
            best = min(((r, k) for k, (a, b) in enumerate(pairwise(symbols)) if (r := self.rank.get(a + b)) is not None), default=None)
            if best is None or len(symbols) == 2:
                return symbols
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that merge into ``piece`` last, or None if merging its characters doesn't make it."""
        parts = self.merge(list(piece))
        return (parts[0], parts[1]) if len(parts) == 2 and parts[0] + parts[1] == piece else None

    def _units(self) -> re.Pattern:
        """What to cut texts into so that no piece reaches across: each unit is blanks, then characters that aren't
        letters, then letters, where letters are such that no piece goes on with anything else behind one of them."""
        inner = {pair for p in self.rank for pair in pairwise(p)}
        if any(b == SPACE and a != SPACE for a, b in inner):
            return re.compile(r"(?s).+")
        letters = {c for p in self.ids for c in p if c.isalpha()}
        while drop := {a for a, b in inner if a in letters and b not in letters}:
            letters -= drop
        kind = "".join(map(re.escape, sorted(letters))) or r"\Z"
        return re.compile(rf"(?s){SPACE}+[^{SPACE}{kind}]*[{kind}]*|[^{SPACE}{kind}]+[{kind}]*|[{kind}]+")

    def _surface(self, numbers: range, silent: set[int], source) -> None:
        """Per id the characters it decodes to, and the byte of byte pieces (-1: none)."""
        self.text = ["" if i in silent or source.is_byte(i) else UNKNOWN if i == self.unknown else source.id_to_piece(i).replace(SPACE, " ") for i in numbers]
        self.byte = np.full(len(numbers), -1, np.int16)
        for byte, i in self.bytes.items():
            self.byte[i] = byte

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both leaves exactly the two: undoes their merges from the last to the first.

        ``until_a`` and ``until_b`` are when the symbols at the border are merged away from it. What the border's symbols
        would merge to comes first if it ranks before both; of equals the left one is first, so the left symbol is gone by then,
        the right one isn't.
        """
        rank, split = self.rank, self.split
        a, b = left, right
        until_a = until_b = 1 << 60
        while True:
            joined = rank.get(a + b)
            if joined is not None and joined < until_a and joined <= until_b:
                return False
            made_a, made_b = rank.get(a, 0), rank.get(b, 0)
            if made_a > made_b:
                until_a, a = made_a, split[a][1]
            elif made_b:
                until_b, b = made_b, split[b][0]
            else:
                return True

    def longest(self, text: str) -> list[str | None]:
        """The longest piece at each place of a text."""
        last, found = len(text) - 1, [None] * len(text)
        for end, piece in self.automaton.iter(text[::-1]):
            if found[last - end] is None:  # the automaton gives the longest first
                found[last - end] = piece
        return found

    def pieces(self, text: str) -> list[str]:
        """The pieces of a run of known characters."""
        n, longest, shorter, fits = len(text), self.longest(text), self.shorter, self.fits
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        at, piece, before = 0, longest[0], ""
        while True:
            while piece is not None:
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1:
                    fit = fits.get((before, piece))
                    if fit is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        fit = fits[before, piece] = not before or self.compatible(before, piece)
                    if fit:
                        break
                piece = shorter[piece]
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError(f"no sequence of pieces for {text[:80]!r}")
                piece = out.pop()
                before = out[-1] if out else ""
                at -= len(piece)
                piece = shorter[piece]
                continue
            out.append(piece)
            if to == n:
                return out
            at, before, piece = to, piece, longest[to]

    def unit_ids(self, unit: str) -> list[int]:
        ids = self.ids
        if self.single.issuperset(unit):
            return [ids[p] for p in self.pieces(unit)] if unit else []
        out: list[int] = []
        start = 0
        for k, char in enumerate(unit):
            if char not in ids:
                if k > start:
                    out += map(ids.__getitem__, self.pieces(unit[start:k]))
                out += [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]
                start = k + 1
        if start < len(unit):
            out += map(ids.__getitem__, self.pieces(unit[start:]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids, all of which the model must have."""
        at = np.flatnonzero(self.byte[ids] >= 0)
        parts = list(map(self.text.__getitem__, ids.tolist()))
        if len(at):
            edges = np.flatnonzero(np.diff(at) > 1) + 1
            for run in np.split(at, edges):
                parts[run[0]] = readable(self.byte[ids[run]].astype(np.uint8).tobytes())
        first = next((k for k, p in enumerate(parts) if p), None)
        if first is not None and self.text[ids[first]].startswith(" ") and ids[first] != self.unknown:
            parts[first] = parts[first][1:]
        return "".join(parts)


def readable(body: bytes) -> str:
    """UTF-8 with BROKEN for each byte that is no part of a character."""
    try:
        return body.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(body):
            for size in (1, 2, 3, 4):
                try:
                    out.append(body[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(BROKEN)
                at += 1
        return "".join(out)


class Remembered(dict):
    """unit -> ids, computed when first asked for; long units are not kept. Once half of REMEMBERED are held they become the old
    ones, from which those asked for again come back; the old ones before them go."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        found = self.old.get(unit)
        if found is None:
            found = tuple(self.model.unit_ids(unit))
        if len(unit) <= LONG:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[unit] = found
        return found


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def remembered(path: str) -> Remembered:
    """A worker's memory, which outlives its tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = Remembered(model(path))
    return _KNOWN[path]


def encode_text(known: Remembered, text: str) -> np.ndarray:
    """The ids of a text and the end id."""
    if not text:
        return np.array([known.model.end], np.int32)
    units = known.model.unit.findall(SPACE + text.replace(" ", SPACE))
    return np.fromiter(chain(chain.from_iterable(map(known.__getitem__, units)), (known.model.end,)), np.int32)


def _ids(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row, the end id last; ``path`` is a model's file that every executor can open."""
    runtime.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path)
        for batch in batches:
            docs, found, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                body = text.as_py() or ""
                docs.append(doc.as_py())
                found.append(encode_text(known, body))
                size += len(body)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), _ids(found)], names=["doc_id", "ids"])
                    docs, found, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), _ids(found)], names=["doc_id", "ids"])

    return df.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"CAST(`{text_col}` AS string) AS body").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of rows of ``encode``: what the ids alone say."""
    runtime.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(path)
        for batch in batches:
            ids = batch.column(1)
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            first, size = 0, 0
            texts: list[str] = []
            for k in range(batch.num_rows):
                texts.append(known.decode(values[ends[k] : ends[k + 1]]))
                size += len(texts[-1])
                if size > BATCH or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns), pa.array(texts, pa.utf8())], names=["doc_id", "ids", "text"])
                    first, size, texts = k + 1, 0, []

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def digest(ids: Column) -> Column:
    """The hex digest of decimal ids joined by blanks."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def digest_columns(encoded: DataFrame, path: str) -> DataFrame:
    return decode(encoded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
