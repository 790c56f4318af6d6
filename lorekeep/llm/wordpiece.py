"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry at each place. A trie over the vocabulary, with
failure links, does this in one pass over a word (Song et al., "Fast WordPiece Tokenization", 2021): where the trie
has no way on, the failure link tells where matching continues, and how many pieces were settled on the way; only
that number is kept, precomputed for each node, so lengths come without building a piece.

The vocabulary is that of a byte-level tokenizer file: pieces are byte strings, and a word begins with a space byte,
which keeps pieces that begin a word apart from those that continue one. Words are runs of non-blank characters.
A word with a place at which no piece fits counts as one unknown piece.

Each Python worker builds the automaton once. Counts of words seen before are remembered up to a fixed number of
words, after which the memory is cleared; results don't depend on it.

Defined results: a null or empty text has no words and no pieces; ids may be null or repeat; an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm import runtime

SCHEMA = "doc_id long, n_words long, n_pieces long, n_unknown long"
#: Words whose counts a worker remembers.
REMEMBERED = 400_000
_COUNTERS: dict[str, PieceCounter] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself,
    the others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def byte_level_pieces(path: str) -> list[bytes]:
    """The vocabulary of a byte-level tokenizer file as byte strings, without its special tokens."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", ())}
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in piece) for piece in data["model"]["vocab"] if piece not in special]


class PieceCounter:
    """The automaton. Nodes are numbers; 0 is the root."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                to = self.next[at].get(byte)
                if to is None:
                    to = len(self.next)
                    self.next[at][byte] = to
                    self.next.append({})
                    ends.append(False)
                at = to
            ends[at] = at != 0
        self._link(ends)

    def _link(self, ends: list[bool]) -> None:
        """fail: where matching continues once the way on is missing (-1: nowhere); popped: the pieces settled then.

        At the end of a piece that piece is settled and matching starts anew. Elsewhere the parent's settled pieces
        come first, then those on the way along its failure links to a node with this byte.
        """
        nodes = len(self.next)
        self.fail, self.popped = [-1] * nodes, [0] * nodes
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in self.next[node].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                at, count = self.fail[node], self.popped[node]
                while at >= 0 and byte not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at][byte], count

    def count(self, word: bytes) -> int:
        """The number of greedy pieces of a word, or -1 if a place has none."""
        step, fail, popped = self.next, self.fail, self.popped
        at, count = 0, 0
        for byte in word:
            to = step[at].get(byte)
            while to is None:
                count += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = step[at].get(byte)
            at = to
        while at:
            count += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return count


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(byte_level_pieces(path))
    return _COUNTERS[path]


class Remembered(dict):
    """word -> number of pieces, computed when first asked for."""

    def __init__(self, automaton: PieceCounter):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.automaton.count(b" " + word)
        return found


def piece_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (doc_id, n_words, n_pieces, n_unknown) for every row; ``vocabulary`` is a byte-level tokenizer file
    that every executor can open."""
    runtime.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(counter(vocabulary))
        for batch in batches:
            words, pieces, unknown = [], [], []
            for text in batch.column(1):
                # bytes.split() parts at the six blanks of ASCII, which are those of the word rule.
                counts = [known[w] for w in (text.as_py() or b"").split()]
                missing = counts.count(-1)
                words.append(len(counts))
                pieces.append(sum(counts) + 2 * missing)
                unknown.append(missing)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, pieces, unknown))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_pieces", "n_unknown"])

    return df.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"CAST(CAST(`{text_col}` AS string) AS binary) AS body").mapInArrow(run, SCHEMA)
