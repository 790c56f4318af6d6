"""Files of a project tree, without what its ignore files, their kind or their size rule out.

Ignore rules become regular expressions over paths that end in a slash, and decisions over them one expression: the
listing is read by Spark and stays distributed. Only the ignore files themselves come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are not entered, files that are not read, and suffixes that are.
SKIP_DIRS = ".git node_modules __pycache__ .venv venv env dist build .next coverage .ruff_cache .mypy_cache .pytest_cache .cache .tox .nox .idea .vscode .ipynb_checkpoints .eggs htmlcov target".split()
SKIP_FILES = (".gitignore", "package-lock.json")
SUFFIXES = ".txt .md .py .js .ts .jsx .tsx .json .yaml .yml .html .css .java .go .rs .rb .sh .csv .sql .toml".split()
MAX_BYTES = 500 * 1024 * 1024


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file in ``base`` ('' or a path with a slash at its end)."""

    base: str
    pattern: str
    folders_only: bool
    negated: bool


def _part(glob: str) -> str:
    """A regular expression for one part of a path."""
    out, k = "", 0
    while k < len(glob):
        c, close = glob[k], glob.find("]", k + 2)
        if c == "[" and close > 0:
            inner = glob[k + 1 : close].replace("\\", r"\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", close
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        k += 1
    return out


def parse(lines: Iterable[str], base: str = "") -> list[Rule]:
    """The rules of an ignore file's lines."""
    rules = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        negated = line.startswith("!")
        line = line[1:] if negated else line
        bare = line.strip("/")
        if bare:
            rooted = line.startswith("/") or "/" in bare
            # A path matches with all below it: nothing is asked of what follows.
            body = "".join("(?:[^/]+/)*" if p == "**" else _part(p) + "/" for p in bare.split("/"))
            rules.append(Rule(base, ("^" if rooted else "(?:^|/)") + body, line.endswith("/"), negated))
    return rules


def decision(path: Column, rules: list[Rule], is_dir: bool) -> Column:
    """True where the last matching rule ignores ``path`` (from the root, without a slash at its end), False where it
    is a negated one, null without a match."""
    slashed = F.concat(path, F.lit("/"))
    folders = slashed if is_dir else F.regexp_replace(path, r"[^/]*$", "")

    def matches(rule: Rule) -> Column:
        at = folders if rule.folders_only else slashed
        below = F.substring(at, len(rule.base) + 1, 1 << 30)
        return at.startswith(rule.base) & below.rlike(rule.pattern)

    return F.coalesce(*(F.when(matches(r), not r.negated) for r in reversed(rules)), F.lit(None).cast("boolean"))


def ignored(path: Column, project: list[Rule], everywhere: list[Rule], git: list[Rule]) -> Column:
    """Whether ``path`` or a folder above it is ignored: the project's rules come first, then those for all, then git's."""
    verdict = lambda p, d: F.coalesce(*(decision(p, r, d) for r in (project, everywhere, git)), F.lit(False))
    parts = F.split(path, "/")
    above = F.filter(F.transform(parts, lambda _, k: F.array_join(F.slice(parts, F.lit(1), k), "/")), lambda p: p != "")
    return F.exists(above, lambda p: verdict(p, True)) | verdict(path, False)


def _ignore_rules(spark: SparkSession, root: str, name: str) -> list[Rule]:
    """Rules of all files called ``name``, those further down later. Spark's reader leaves hidden files out, so Hadoop's
    globs find them, one level at a time; the driver gets the ignore files alone."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    glob = lambda pattern: fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(base + pattern)) or []
    rules, level = [], ""
    while level == "" or len(glob(level.rstrip("/"))):
        for at in sorted(s.getPath().toString() for s in glob(level + name)):
            stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(at))
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            stream.close()
            rules += parse(text.splitlines(), at[len(base) : -len(name)])
        level += "*/"
    return rules


def scan(
    spark: SparkSession,
    root: str,
    *,
    respect_git: bool = True,
    project_file: str = ".lorekeepignore",
    everywhere: Iterable[str] = (),
    include: Iterable[str] = (),
    only_included: bool = False,
) -> DataFrame:
    """(path, size, modified, content) of the files under ``root``; paths are from there.

    ``everywhere`` are ignore lines for all projects. Paths in ``include``, and all below them, are taken although
    ignored, those named in full with any suffix. Files over 500 MB are left out. Contents are read only for files that
    are kept, and only if they are asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # The reader's paths are URIs: a local one begins with ``file:`` and one or three slashes.
    place = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(place) + "/", "")
    listing = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    git = _ignore_rules(spark, root, ".gitignore") if respect_git else []
    project = _ignore_rules(spark, root, project_file)
    wanted = [w.strip("/") for w in include]
    at = F.col("path")
    any_of = lambda tests: F.coalesce(*(F.when(t, True) for t in tests), F.lit(False))
    exact = any_of(at == w for w in wanted)
    forced = any_of((at == w) | at.startswith(w + "/") for w in wanted)
    name = F.regexp_extract(at, r"([^/]*)$", 1)
    folders = F.split(F.regexp_replace(at, r"[^/]*$", ""), "/")
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRS))) | name.isin(*SKIP_FILES, project_file)
    readable = F.lower(name).rlike("(" + "|".join(map(re.escape, SUFFIXES)) + ")$")
    kept = (forced | ~(skipped | ignored(at, project, parse(everywhere), git))) & (readable | exact) & (F.col("size") <= MAX_BYTES)
    return listing.where(kept & forced if only_included else kept)


def unread(listing: DataFrame, stored: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Files of ``listing`` (path, modified, ...) that ``stored`` (source_file, modified) doesn't hold as of that time."""
    known = stored.select("source_file", F.col("modified").cast("double").alias("_at"))
    same = (listing["path"] == known["source_file"]) & (F.abs(listing["modified"].cast("double") - known["_at"]) < tolerance)
    return listing.join(known, same, "left_anti")
