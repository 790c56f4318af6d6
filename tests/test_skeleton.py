"""Skeletons by example, against Python's own parser, and in ingest."""

import ast
import random

from pyspark.sql import functions as F

from lorekeep.functions import skeleton as S
from lorekeep.operators import ingest
from lorekeep.sources.versions import VersionedTable

CODE = '''#!/usr/bin/env python
"""Module."""
import os, sys
from a.b import (
    c,  # why
    d,
)

LIMIT: int = 3
NAMES = {"x": 1, "def": "class F:"}
a, b = 1, 2
count += 1
x == 3
print(a=1)
if a: b = 2
match x:
    case 1:
        Y = 1
try:
    import json
except ImportError:
    json = None


@decorate(1,
          k="):")
@plain
class One(Base, metaclass=Meta):
    """Of one.

    Two lines: here.
    """

    size: int
    kind = "a" \\
        "b"

    def run(self, n: dict[str, int] = {"a": 1}, *, f=lambda q: q) -> "int":
        """Runs."""
        def inner(z):
            """Hidden."""
            return z
        W = 1
        return inner(n)

    class Deep:
        @property
        async def go(self): return {1: 2}

        if True:
            lost = 1


class Empty: pass


def last(
    a,
    b=")",
):
\treturn f"{a}: {b}"
'''

WANT = '''import os, sys

from a.b import ( c, d, )

LIMIT: int = 3

NAMES = {"x": 1, "def": "class F:"}

a, b = 1, 2

@decorate(1, k="):")
@plain
class One(Base, metaclass=Meta):
    """Of one.

    Two lines: here.
    """
    size: int
    kind = "a" "b"
    def run(self, n: dict[str, int] = {"a": 1}, *, f=lambda q: q) -> "int":
        """Runs."""

    class Deep:
        @property
        async def go(self):
            pass



class Empty:
    pass

def last( a, b=")", ):
    pass'''


def test_python():
    assert S.skeleton(CODE) == WANT
    ast.parse(WANT)
    for broken in ("def f(:\n  x = (", "x = 'open\n", "y = )", "z = (]", '"""never closed'):
        assert S.skeleton(broken) == ""
    assert S.skeleton("") == S.skeleton("# only\n\n") == ""
    assert S.skeleton("def f():\n    x = 1\n    'no doc'\n") == "def f():\n    pass"
    assert S.skeleton("class C:\r\n    a = 1\r\n") == "class C:\n    a = 1"


def names(tree) -> list:
    """Names of classes and functions outside of functions, in order, with their depth."""
    out = []

    def walk(node, depth):
        for child in node.body:
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((depth, type(child).__name__, child.name, ast.get_docstring(child), [ast.unparse(d) for d in child.decorator_list]))
                if isinstance(child, ast.ClassDef):
                    walk(child, depth + 1)
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                out.append((depth, ast.unparse(child)))
            elif depth == 0 and isinstance(child, (ast.Import, ast.ImportFrom)):
                out.append((depth, ast.unparse(child)))

    walk(tree, 0)
    return out


def test_against_the_parser():
    """Of this machine's standard library the skeletons parse and tell what the parser finds in the sources."""
    import argparse
    import collections
    import dataclasses
    import email.message
    import json.decoder
    import textwrap
    import typing

    for module in (argparse, collections, dataclasses, email.message, json.decoder, textwrap, typing, ingest):
        code = open(module.__file__).read()
        assert names(ast.parse(S.skeleton(code))) == names(ast.parse(code)), module.__name__


def test_scripts(spark):
    code = "export const a = async (x,\n y) => x\nfunction f(a) {\n  function no() {}\n}\nexport class B extends C {}\nclass D{}\nlet g = function () {}\nasync function h() {}\n"
    df = spark.createDataFrame([(code,), ("none",), ("",), (None,)], "t string")
    want = "function f(a)\nasync function h()\nexport class B extends C\nclass D\nexport const a = async (x,\n y) =>\nlet g = function ()"
    assert [r[0] for r in df.select(S.script_skeleton(F.col("t"))).collect()] == [want, "", "", None]


def test_which_are_shortened(spark):
    body = "def f(a):\n" + "    a += 1\n" * 2001
    rows = [("p/a.py", body), ("p/a.PY", body), ("p/a.txt", body), ("p/.py", body), ("p/b.py", body[:900]), ("p/c.py", "K = 1\n" * 2001), ("p/d.py", body + "("), ("p/e.ts", "function f() {\n" + "x\n" * 2001), ("p/f.py", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r[0]: r[1] for r in df.select("path", S.shortened(F.col("path"), F.col("text"))).collect()}
    assert {p for p, s in got.items() if s} == {"p/a.py", "p/a.PY", "p/e.ts"} and got["p/a.py"] == "def f(a):\n    pass"


def test_ingest_and_restore(spark, tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    (root / "large.py").write_text("\n\n".join(f"def part_{k}(x, y=None):\n" + "\n".join(f"    line_{j} = {j} * 2  # some text" for j in range(10)) for k in range(300)))
    (root / "small.py").write_text("def small(value):\n    return value  # it does no more than this one thing\n" * 2)
    table = VersionedTable(spark, str(tmp_path / "table"), buckets=4)
    rooms = {"code": ["def"]}
    ingest.ingest_project(spark, str(root), table, "d", rooms, "me")

    def said(name):
        return "\n".join(r["document"] for r in table.read().where(F.col("source_file").endswith(name)).orderBy("chunk_index").collect())

    assert "part_299" in said("large.py") and "line_0" not in said("large.py") and "no more" in said("small.py")
    (target,) = ingest.skeleton_sources(table.read()).collect()
    assert target["source_file"].endswith("large.py") and target["domain"] == "d"
    ingest.restore_sources(spark, str(root), table, "d", rooms, "me")
    assert "line_9 = 9" in said("large.py") and ingest.skeleton_sources(table.read()).count() == 0
    assert ingest.restore_sources(spark, str(root), table, "d", rooms, "me") is None


def test_alike_statements_are_walked_once(monkeypatch):
    """Statements that repeat are read once, plain lines not token by token; what whole files give is what one walk over them gives."""
    calls = []
    walked = S._walked
    monkeypatch.setattr(S, "_walked", lambda code: calls.append(code) or walked(code))
    S._remembered.cache_clear()
    code = "def f(a):\n    x = {'k': [1, (2,\n 3)]}\n    return x\n\n\nK_1 = 2\n" * 50
    assert len(S.statements(code)) == 200 and len(calls) == 2
    for odd in ("a = (\\\n1)\\\n", "x = '''(\n''' \\\n\\", "def f(:\n  pass", "@d:\\\n\\", "\tif x:\n  y=1\r\n", "a==b=c", "x = [[[[[[1]]]]]]\ny: int = 2\n", "'a\n"):
        assert S.statements(odd) == walked(odd), odd


PIECES = ["a", "def f", "class C", ":", "=", "==", "x = ", "(", ")", "[", "]", "{", "}", "'s'", '"t u"', "'''m\nn'''", "# c'\n", "#d(\n", " ", "  ", "\t", "\n", "\n", "\n    ", "\n  ", "\\\n", "\\", "'", '"', ":=", "+=", "@d", "import q", "return 1", "(a, b)", "{'k': (1)}", "\n\n", "\f", "漢字", "r", "R'x'", "%s", "async def g():", "if", "import_", "    '''doc'''", "\n@x\ndef h(): pass\n"]


def test_outlined_in_pieces():
    """Outermost statements one by one, with letters for words, give what the whole source gives."""
    rng = random.Random(11)
    for _ in range(8000):
        code = "".join(rng.choices(PIECES, k=rng.randrange(1, 24)))
        whole = S._outline(code, ())
        assert S.skeleton(code) == ("" if whole is None else "\n".join(whole[0]).strip()), code


def test_alike_functions_are_read_once(monkeypatch):
    """However often a function or class comes, its statements are read once."""
    read, old = [], S._statements
    monkeypatch.setattr(S, "_statements", lambda code: read.append(len(code)) or old(code))
    unit = "@once\ndef some_function_read_once(a, b):\n    '''Says.'''\n    if a:\n        return [b]\n\nclass SomeClassReadOnce:\n    size: int\n"
    got = S.skeleton(unit * 500)
    assert got.count("def some_function_read_once(a, b):\n    '''Says.'''") == 500 and got.count("@once") == 500
    assert sum(read) <= 2 * len(unit)
