"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor goes over them in order: text is escaped
and written, every other part becomes a placeholder, and is recorded with its reference, the placeholder's place
and the tokens that it will expand to. The template marks each turn; strings that steer a model (marks of this
template and of common others) are escaped inside texts, so that no text can open or close a turn, and read back
exactly. The loss mask covers the texts of assistants, and nothing else.

Turns are formatted where they lie, each by itself. Conversations are read back from the formatted turns, sorted by
conversation, one turn at a time: a task holds an Arrow batch and a running digest, however long a conversation is. A
digest over a whole conversation has to be taken in order, so that of a very long one is taken by one task, over
text that others have formatted.

Defined results: null texts and roles count as empty; a null list of parts is an empty message; unknown part types
raise an error; repeated rows are turns like others, ordered by turn (nulls first), role and text; rows with a null
conversation form one; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import runtime

#: Strings that must not stand in a text as they are; the escape goes behind their first character.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, HEAD, END = "<|turn:", "|>\n", "<|end|>\n"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: What attachments expand to: tokens for an image tile of so many pixels a side, a second of audio, a page.
TILE, PER_TILE, PER_SECOND, PER_PAGE = 28, 1, 25, 512

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TURNS = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, text_words long, expanded_tokens long, attachments array<struct<kind:string,ref:string,part:int,at:int,tokens:long>>"
ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("part", pa.int32()), ("at", pa.int32()), ("tokens", pa.int64())]))
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long"

_ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\|"}
_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\|]|\\.)*)" + re.escape(HEAD) + "(.*)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n|]", lambda m: _ROLE[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class Visitor:
    """Writes the parts of one message; ``visit`` picks the method by a part's type."""

    out: list[str] = field(default_factory=list)
    size: int = 0
    words: int = 0
    tokens: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, number: int, part: dict) -> None:
        method = getattr(self, f"visit_{part['type']}", None)
        if method is None:
            raise ValueError(f"unknown part type {part['type']!r}")
        method(number, part)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit_text(self, number: int, part: dict) -> None:
        text = part["text"] or ""
        self.words += len(text.split())
        self.write(escape(text))

    def attach(self, number: int, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": part["type"], "ref": part["ref"], "part": number, "at": self.size, "tokens": tokens})
        self.tokens += tokens
        self.write(PLACEHOLDER[part["type"]])

    def visit_image(self, number: int, part: dict) -> None:
        self.attach(number, part, max(1, math.ceil((part["width"] or 0) / TILE) * math.ceil((part["height"] or 0) / TILE) * PER_TILE))

    def visit_audio(self, number: int, part: dict) -> None:
        self.attach(number, part, max(1, math.ceil((part["seconds"] or 0) * PER_SECOND)))

    def visit_document(self, number: int, part: dict) -> None:
        self.attach(number, part, max(1, (part["pages"] or 0) * PER_PAGE))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in none.items())))


def format_turns(turns: DataFrame) -> DataFrame:
    """Formats rows of (conv_id, turn, role, parts); offsets are code points of the formatted turn."""
    runtime.ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, starts, ends, words, tokens, attachments = [], [], [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                head = OPEN + escape_role(role or "") + HEAD
                visitor = Visitor()
                visitor.write(head)
                for number, part in enumerate(parts.as_py() or ()):
                    visitor.visit(number, part)
                formatted.append("".join(visitor.out) + END)
                learn = role == "assistant"
                starts.append(len(head) if learn else 0)
                ends.append(visitor.size if learn else 0)
                words.append(visitor.words)
                tokens.append(visitor.tokens)
                attachments.append(visitor.attachments)
            columns = [*batch.columns[:3], pa.array(formatted, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(attachments, ATTACHMENTS)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "text_words", "expanded_tokens", "attachments"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(PARTS))
    return rows.mapInArrow(run, TURNS)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay in the text as they are."""
    found = _TURN.fullmatch(formatted)
    if found is None:
        raise ValueError("not a formatted turn")
    return unescape_role(found[1]), unescape(found[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted turns and their loss masks alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, state = [], None, None

        def close():
            if state is not None:
                n, turns, chars, loss, size, attached = state
                done.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, attached))

        def flush():
            names = [x.split()[0] for x in READ_BACK.split(", ")]
            kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)

        for conv, text, start, end, attached in rows(batches):
            if state is None or now != (conv,):
                close()
                if len(done) >= 5000:
                    yield flush()
                    done.clear()
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, said = parse_turn(text)
            learned = unescape(text[start:end])
            state[0] += 1
            state[1].update(f"{role}\n{said}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(text)
            state[5] += attached
        close()
        yield flush()

    # The last key is the text as it was before escaping; it is computed only where all others tie.
    said = F.regexp_replace(F.substr("formatted", F.lit(1), F.length("formatted") - len(END)), r"(?s)\\(.)", "$1")
    rows_in = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", said)
    return rows_in.select("conv_id", "formatted", "loss_start", "loss_end", F.size("attachments").alias("n")).mapInArrow(run, READ_BACK)
