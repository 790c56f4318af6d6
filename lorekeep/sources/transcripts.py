"""Chat exports of several dialects as one transcript format.

Each parser maps a file's whole text to an array of (role, text), or to null where the file isn't of its dialect;
``messages`` takes the first that fits. Parsers are expressions over VARIANT values, but for the tree of the mapping
dialect, which has to be walked.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.noise import strip, strip_noise

#: Files over this size are not read.
MAX_BYTES = 500 * 1024 * 1024
SUFFIXES = (".txt", ".md", ".json", ".jsonl")
MESSAGES = "array<struct<role:string,text:string>>"
MESSAGES_TYPE = T.ArrayType(T.StructType().add("role", "string").add("text", "string"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, content) of the chat files under ``root``, without ``.meta.json`` files and large ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.lower("path")
    wanted = name.rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$") & ~name.endswith(".meta.json")
    return files.where(wanted & (F.col("length") <= MAX_BYTES)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _text_of(value: Column, path: str) -> Column:
    """The text at ``path``: a string, the text blocks of a list, or the ``text`` of an object."""
    blocks = _get(value, path, "array<variant>")
    plain = lambda b: F.schema_of_variant(b) == "STRING"
    kept = F.filter(blocks, lambda b: plain(b) | (_get(b, "$.type") == "text"))
    joined = F.array_join(F.transform(kept, lambda b: F.when(plain(b), _get(b, "$")).otherwise(F.coalesce(_get(b, "$.text"), F.lit("")))), " ")
    found = _get(value, path, "variant")
    single = F.when(F.schema_of_variant(found) == "STRING", _get(value, path)).otherwise(_get(value, f"{path}.text"))
    return strip(F.coalesce(F.when(blocks.isNotNull(), joined), single, F.lit("")))


def _message(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _role(name: Column, users: tuple[str, ...], assistants: tuple[str, ...]) -> Column:
    return F.when(name.isin(*users), "user").when(name.isin(*assistants), "assistant")


def _enough(found: Column, gate: Column | None = None) -> Column:
    """``found`` without empty messages, if at least two remain and ``gate`` holds."""
    kept = F.filter(found, lambda m: m["role"].isNotNull() & m["text"].isNotNull() & (m["text"] != ""))
    ok = F.size(kept) >= 2
    return F.when(ok if gate is None else ok & gate, kept)


def _lines(content: Column) -> Column:
    """The JSON objects among the lines; other lines are skipped."""
    lines = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x.startswith("{"))
    return F.filter(F.transform(lines, F.try_parse_json), lambda x: x.isNotNull())


def agent_lines(content: Column) -> Column:
    """Lines of type human, user or assistant; noise is stripped from each message."""
    of = lambda e: _message(_role(_get(e, "$.type"), ("human", "user"), ("assistant",)), strip_noise(_text_of(e, "$.message.content")))
    return _enough(F.transform(_lines(content), of))


def rollout_lines(content: Column) -> Column:
    """event_msg lines of a file that has a session_meta line."""
    entries = _lines(content)
    events = F.filter(entries, lambda e: _get(e, "$.type") == "event_msg")
    said = lambda e: F.when(F.schema_of_variant(_get(e, "$.payload.message", "variant")) == "STRING", strip(_get(e, "$.payload.message")))
    of = lambda e: _message(_role(_get(e, "$.payload.type"), ("user_message",), ("agent_message",)), said(e))
    return _enough(F.transform(events, of), F.exists(entries, lambda e: F.coalesce(_get(e, "$.type") == "session_meta", F.lit(False))))


def session_lines(content: Column) -> Column:
    """Message lines of users and assistants in a file whose session header names a version."""
    entries = _lines(content)
    sent = F.filter(entries, lambda e: _get(e, "$.type") == "message")
    of = lambda e: _message(_role(_get(e, "$.message.role"), ("user",), ("assistant",)), strip_noise(_text_of(e, "$.message.content")))
    header = lambda e: F.coalesce((_get(e, "$.type") == "session") & _get(e, "$.version", "variant").isNotNull(), F.lit(False))
    return _enough(F.transform(sent, of), F.exists(entries, header))


def message_list(content: Column) -> Column:
    """A list of messages, alone or under ``messages`` or ``chat_messages``; or conversations with such lists."""
    root = F.try_parse_json(content)
    items = F.coalesce(_get(root, "$.messages", "array<variant>"), _get(root, "$.chat_messages", "array<variant>"), _get(root, "$", "array<variant>"))
    nested = F.coalesce(_get(F.get(items, F.lit(0)), "$.chat_messages", "variant").isNotNull(), F.lit(False))
    inner = F.flatten(F.transform(items, lambda c: F.coalesce(_get(c, "$.chat_messages", "array<variant>"), F.array().cast("array<variant>"))))
    of = lambda m: _message(_role(_get(m, "$.role"), ("user", "human"), ("assistant", "ai")), _text_of(m, "$.content"))
    return _enough(F.transform(F.when(nested, inner).otherwise(items), of))


def _branch(tree: dict) -> list[dict]:
    """Messages from the root along first children; a node seen before ends the walk."""
    tops = [(n.get("message") is not None, k) for k, (_, n) in enumerate(tree.items()) if n.get("parent") is None]
    at = list(tree)[min(tops)[1]] if tops else None
    out, seen = [], set()
    while at in tree and at not in seen:
        seen.add(at)
        message = tree[at].get("message") or {}
        content = message.get("content")
        parts = content.get("parts") or [] if isinstance(content, dict) else []
        text = " ".join(p for p in parts if isinstance(p, str) and p).strip()
        out.append({"role": (message.get("author") or {}).get("role"), "text": text})
        at = next(iter(tree[at].get("children") or []), None)
    return [m for m in out if m["role"] in ("user", "assistant") and m["text"]]


@F.pandas_udf(MESSAGES_TYPE)
def _walk(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text: str | None) -> list[dict] | None:
        try:
            data = json.loads(text) if text is not None else None
            found = _branch(data["mapping"]) if isinstance(data, dict) and isinstance(data.get("mapping"), dict) else []
        except (ValueError, AttributeError, TypeError):
            return None
        return found if len(found) >= 2 else None

    for series in texts:
        yield series.map(one)


def mapping_tree(content: Column) -> Column:
    """An export whose messages form a tree under ``mapping``. Only files that name one are handed to Python."""
    return _walk(F.when(content.contains('"mapping"'), content))


def channel(content: Column) -> Column:
    """A channel's messages: the first speaker is the user; others get, when first seen, the role opposite to the last."""
    items = F.filter(_get(F.try_parse_json(content), "$", "array<variant>"), lambda m: _get(m, "$.type") == "message")
    said = F.transform(items, lambda m: F.struct(F.coalesce(_get(m, "$.user"), _get(m, "$.username"), F.lit("")).alias("who"), strip(F.coalesce(_get(m, "$.text"), F.lit(""))).alias("text")))
    said = F.filter(said, lambda m: (m["who"] != "") & (m["text"] != ""))
    start = F.struct(F.create_map().cast("map<string,string>").alias("roles"), F.lit(None).cast("string").alias("last"), F.array().cast(MESSAGES).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        known = F.element_at(acc["roles"], m["who"])
        role = F.coalesce(known, F.when(acc["last"] == "user", "assistant").otherwise("user"))
        roles = F.when(known.isNotNull(), acc["roles"]).otherwise(F.map_concat(acc["roles"], F.map_from_arrays(F.array(m["who"]), F.array(role))))
        return F.struct(roles.alias("roles"), role.alias("last"), F.concat(acc["out"], F.array(_message(role, m["text"]))).alias("out"))

    return _enough(F.aggregate(said, start, step, lambda acc: acc["out"]))


#: In the order in which they are tried.
DIALECTS: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("agent", agent_lines),
    ("rollout", rollout_lines),
    ("session", session_lines),
    ("messages", message_list),
    ("mapping", mapping_tree),
    ("channel", channel),
)


def transcript(messages: Column) -> Column:
    """Lines of users begin with ``> ``; a blank line follows each exchange, and each message outside of one."""
    last = F.size(messages) - 1

    def render(m: Column, k: Column) -> Column:
        replied = (m["role"] == "user") & (k < last) & (F.get(messages, k + 1)["role"] == "assistant")
        text = F.when(m["role"] == "user", F.concat(F.lit("> "), m["text"])).otherwise(m["text"])
        return F.concat(text, F.when(replied, "\n").otherwise("\n\n"))

    return F.regexp_replace(F.array_join(F.transform(messages, render), ""), r"\n\z", "")


def normalise(files: DataFrame) -> DataFrame:
    """(path, dialect, transcript) of (path, content): texts with three or more quoted lines, and of no dialect, as they are."""
    quoted = F.size(F.filter(F.split("content", "\n"), lambda x: strip(x).startswith(">")))
    is_json = (quoted < 3) & strip(F.col("content")).rlike(r"\A[\[{]")
    found = files
    for name, parse in DIALECTS:
        found = found.withColumn(f"_{name}", parse(F.when(is_json, F.col("content"))))
    dialect = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), n) for n, _ in DIALECTS), F.lit("plain"))
    messages = F.coalesce(*(F.col(f"_{n}") for n, _ in DIALECTS))
    return found.select("path", dialect.alias("dialect"), F.coalesce(transcript(messages), "content").alias("transcript"))
