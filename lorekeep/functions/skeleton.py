"""Skeletons of source files: what they define, without the bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.noise import strip

# Signatures at the start of a line, and above how many lines or characters a file is worth a skeleton.
SIGNATURES = (
    r"^(?:export\s+)?(?:async\s+)?function\s+\w+\s*\([^)]*\)",
    r"^(?:export\s+)?class\s+\w+\s*(?:extends\s+\w+)?",
    r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*function\s*\([^)]*\)",
)
LINES, CHARACTERS = 2000, 200_000

PARTS = re.compile(
    r'''(?P<string>"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')'''
    r"""|(?P<note>\#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<join>\\\n)|(?P<line>\n)|(?P<blank>[^\S\n]+)|(?P<bad>["'])|(?P<other>[^\s"'\#()\[\]{}\\:=]+|.)""",
    re.S,
)
PAIRS = {"(": ")", "[": "]", "{": "}"}
TARGET = re.compile(r"[\w.]+(?:\[.*\])?|\(.*\)", re.S)
STATES = re.compile(r"(?:return|raise|assert|del|lambda|yield|await|if|for|while|with|case|match)\b")


_PART = r"""[^"'#()\[\]{}\\\n]++|""" + PARTS.pattern[len("(?P<string>") : PARTS.pattern.index("|(?P<note>") - 1].join(("(?:", ")")) + r"|\#[^\n]*+|\\(?=[^\n])|\\\n"
_NESTED = ""
for _ in range(4):
    _NESTED = rf"""|[(\[{{](?:\n|{_PART}{_NESTED})*+[)\]}}]"""
#: A whole statement or an empty line, where brackets are no deeper than four.
STATEMENT = re.compile(rf"(?:{_PART}{_NESTED})*+", re.S)
#: A statement from the start of a line, and those after it that are indented, comments or empty.
OUTERMOST = re.compile(rf"{STATEMENT.pattern}(?:\n(?=[\s\#\\]|\Z){STATEMENT.pattern})*+", re.S)
#: How statements begin.
BEGINS, HEAD, IMPORT = re.compile(r"[rRuU]?[\"']"), re.compile(r"(class|def|async def)\s"), re.compile(r"(?:import|from)\s")
SIGNS, EQUALS = re.compile(r"""["'#()\[\]{}\\]"""), re.compile(r"(?<![=<>!+\-*/%&|^@:])=(?!=)")
#: Words that tell what a statement is or whether it begins with a string, and letters that stand for all others.
TELLING, WORD = frozenset("class def async import from return raise assert del lambda yield await if for while with case match r R u U".split()), re.compile(r"(\w+)")
FIRST, PLACE = 0x4E00, re.compile("[\u4e00-\u4fff]")
#: Characters of a statement, and of an outermost one with what is inside, and how many of each a worker remembers.
SHORT, INSIDE, MANY = 200, 400, 100_000


def _walked(code: str) -> list[tuple[int, str, int, int]] | None:
    """As ``statements``, token by token."""
    out: list[tuple[int, str, int, int]] = []
    text, size, open_, indent, colon, equals = [], 0, [], 0, -1, -1

    def end() -> None:
        nonlocal text, size, indent, colon, equals
        if whole := "".join(text).rstrip():
            out.append((indent, whole, colon, equals))
        text, size, indent, colon, equals = [], 0, 0, -1, -1

    for m in PARTS.finditer(code):
        kind, part = m.lastgroup, m.group()
        if kind == "line" and not open_:
            end()
            continue
        if kind in ("blank", "line", "join"):
            if text and not text[-1].endswith(" "):
                text.append(" ")
                size += 1
            elif not text and kind == "blank":
                indent = len(part.expandtabs(8))
            continue
        if kind == "note":
            continue
        if kind == "bad" or (kind == "close" and (not open_ or PAIRS[open_.pop()] != part)):
            return None
        if not open_ and part == ":" and colon < 0:
            colon = size
        if not open_ and part == "=" and equals < 0 and code[m.end() : m.end() + 1] != "=" and code[m.start() - 1 : m.start()] not in tuple("=<>!+-*/%&|^@:"):
            equals = size
        if kind == "open":
            open_.append(part)
        text.append(part)
        size += len(part)
    if open_:
        return None
    end()
    return out


def _kind(text: str, colon: int, equals: int) -> tuple[str, bool]:
    """What a statement is (class, def, mark, block, import, assignment or other), and whether it begins with a string."""
    string = BEGINS.match(text) is not None
    if (head := HEAD.match(text)) and colon >= 0:
        return "class" if head.group(1) == "class" else "def", string
    if text.startswith("@"):
        return "mark", string
    if colon >= 0 and colon == len(text) - 1:
        return "block", string
    if IMPORT.match(text):
        typed = 0 < colon and TARGET.fullmatch(text[:colon].strip()) and (equals < 0 or colon < equals)
        return "import" if not (typed or equals > 0) else "both", string
    typed = 0 < colon and TARGET.fullmatch(text[:colon].strip()) and (equals < 0 or colon < equals)
    return "assignment" if (typed or equals > 0) and not STATES.match(text) else "other", string


def _line(code: str) -> list[tuple[int, str, int, int]]:
    """The statement of a line without quotes, brackets, comments and backslashes."""
    text = " ".join(code.split())
    indent = len(code[: len(code) - len(code.lstrip())].expandtabs(8))
    return [(indent, text, text.find(":"), m.start() if (m := EQUALS.search(text)) else -1)] if text else []


def _parsed(code: str) -> list[tuple] | None:
    found = _walked(code) if SIGNS.search(code) or "\n" in code[:-1] else _line(code)
    return found and [(*s, *_kind(*s[1:])) for s in found]


_remembered = lru_cache(MANY)(_parsed)


def _statements(code: str) -> list[tuple] | None:
    """(indentation, text, colon, equals, kind, string) of each statement: one after the other, and what is alike only once."""
    out: list[tuple] = []
    at, match = 0, STATEMENT.match
    while at < len(code):
        end = match(code, at).end() + 1
        if code[end - 1 : end] != "\n":
            end = len(code)
        found = (_remembered if end - at <= SHORT else _parsed)(code[at:end])
        if found is None:
            return None
        out += found
        at = end
    return out


def statements(code: str) -> list[tuple[int, str, int, int]] | None:
    """(indentation, text, colon, equals) of each statement: its lines joined, without comments; where its first colon and its assignment
    outside of brackets are, or -1. None where brackets or quotes don't match."""
    found = _statements(code)
    return found and [s[:4] for s in found]


def skeleton(code: str) -> str:
    """Imports, assignments, classes and functions with their decorators and docstrings, in order; of functions no bodies, of other blocks
    nothing. Lines are as written, but for comments, blanks and breaks inside a statement. Empty where brackets or quotes don't match.

    Nothing but decorators reaches from one outermost statement to the next, so what is alike is outlined only once."""
    out: list[str] = []
    marks: tuple[str, ...] = ()
    at, size, match = 0, len(code), OUTERMOST.match
    while at < size:
        end = match(code, at).end()
        if end < size:  # brackets or quotes that don't match, or too deep ones: all the rest
            end = end + 1 if code[end] == "\n" else size
        found = (_outlined if end - at <= INSIDE else _outline)(code[at:end], marks)
        if found is None:
            return ""
        out += found[0]
        marks = found[1]
        at = end
    return "\n".join(out).strip()


def _outline(code: str, marks: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """The skeleton's lines of code that begins with an outermost statement, after decorators ``marks``, and the decorators that
    wait at its end; None where brackets or quotes don't match."""
    found = _statements(code)
    if found is None:
        return None
    out: list[str] = []
    blocks: list[dict] = []  # open blocks: the indentation of their head, whether a class, a function or another, and if lines came out
    others = 0  # open blocks that are no classes

    def close(indent: int) -> None:
        nonlocal others
        while blocks and indent <= blocks[-1]["indent"]:
            block = blocks.pop()
            others -= block["kind"] != "class"
            if block["kind"] != "other":
                if not block["filled"]:
                    out.append("    " * block["level"] + "    pass")
                out.append("")

    for indent, text, colon, _, what, string in found:
        if blocks and indent <= blocks[-1]["indent"]:
            close(indent)
        inside = blocks[-1] if blocks else None
        first = inside is not None and not inside["begun"]
        if inside:
            inside["begun"] = True
        shut = others > 0
        pad = "    " * len(blocks)
        if string and first and inside["kind"] != "other" and others <= 1:
            out.append(pad + text)
            inside["filled"] = True
            continue
        if what in ("class", "def"):
            if not shut:
                out.extend([*(pad + mark for mark in marks), pad + text[: colon + 1]])
                if inside:
                    inside["filled"] = True
            one_line = bool(text[colon + 1 :].strip())
            kind = "other" if shut else what
            others += kind != "class"
            blocks.append({"indent": indent, "kind": kind, "level": len(blocks), "filled": False, "begun": one_line})
            marks = ()
        elif what == "mark":
            marks += (text,)
        elif what == "block":
            others += 1
            blocks.append({"indent": indent, "kind": "other", "level": len(blocks), "filled": True, "begun": True})
            marks = ()
        elif not shut and (what in ("assignment", "both") or (what == "import" and not blocks)):
            out.append(pad + text)
            if inside:
                inside["filled"] = True
            else:
                out.append("")
    close(0)
    return tuple(out), marks


@lru_cache(MANY)
def _shape(code: str) -> tuple[str | None, tuple[int, ...]] | None:
    """The lines of ``_outline`` as a format, with the numbers of the words that fill it; no format if there are no lines; None where
    brackets or quotes don't match. A decorator that waits has the number -1."""
    found = _outline(code, ())
    if found is None:
        return None
    if found[1]:
        return "", (-1,)
    text = "\n".join(found[0]).replace("%", "%%")
    return PLACE.sub("%s", text) if found[0] else None, tuple(ord(c) - FIRST for c in PLACE.findall(text))


@lru_cache(MANY)
def _outlined(code: str, marks: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """``_outline``, its lines joined. What a word is matters only if it is one of TELLING: each other one is a letter of its own, and
    code that is alike but for its words is outlined once."""
    if marks:
        return _outline(code, marks)
    parts = WORD.split(code)
    words = parts[1::2]
    parts[1::2] = [w if w in TELLING else chr(FIRST + k) for k, w in enumerate(words)]
    shape = _shape("".join(parts))
    if shape is None:
        return None
    text, at = shape
    if at[:1] == (-1,):
        return _outline(code, ())
    return () if text is None else (text % tuple([words[k] for k in at]),), ()


@F.pandas_udf(T.StringType())
def _skeletons(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in codes:
        yield series.map(lambda c: skeleton(c) if c is not None else None)


def python_skeleton(code: Column) -> Column:
    """The skeleton of a Python source; brackets and indentation decide what belongs where, so Python walks each file."""
    return _skeletons(code)


def script_skeleton(code: Column) -> Column:
    """The signatures of a JavaScript or TypeScript source, one kind after the other, each in its order. A null code gives null."""
    found = F.flatten(F.array(*(F.regexp_extract_all(code, F.lit(f"(?mdU){pattern}"), 0) for pattern in SIGNATURES)))
    return F.array_join(F.transform(found, strip), "\n")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def shortened(path: Column, text: Column, lines: int = LINES, characters: int = CHARACTERS) -> Column:
    """The skeleton of a large source that is less than half as long; null for any other file."""
    large = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) > lines) | (F.length(text) > characters)
    end = ending(path)
    only = lambda *ends: F.when(large & end.isin(*ends), text)
    short = F.coalesce(python_skeleton(only(".py")), script_skeleton(only(".js", ".ts", ".jsx", ".tsx")))
    return F.when((short != "") & (F.length(short) * 2 < F.length(text)), short)
