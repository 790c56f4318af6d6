"""Chunks by brute force, and a project read into a versioned table."""

import random

import pytest

from lorekeep.operators import ingest
from lorekeep.operators.chunks import cut
from lorekeep.sources.versions import VersionedTable


def slow_cut(text, size, overlap, least):
    """Tries every place of every window."""
    text, out, start, done = text.strip(), [], 0, 0
    if len(text) < least:
        return out
    while start < len(text):
        high = min(start + size, len(text))
        stop = high
        if high < len(text):
            places = range(high, start + size // 2 - 1, -1)
            tests = (lambda k: k + 2 <= high and text[k : k + 2] == "\n\n", lambda k: k < high and text[k] == "\n", lambda k: text[k - 1] in ".!?" and (k == high or text[k].isspace()), lambda k: k < high and text[k] in " \t")
            stop = next((k for t in tests for k in places if t(k)), high)
        first = start
        while first and len(text[first:stop].strip()) < least:
            first -= 1
        if len(text[start:stop].strip()) >= least or text[max(start, done) : stop].strip():
            out.append(text[first:stop].strip())
            done = stop
        if stop == len(text):
            break
        start = stop - overlap
        if not text[start - 1].isspace():
            word = next((k for k in range(start + 1, len(text)) if text[k - 1].isspace() and not text[k].isspace()), len(text))
            if word <= stop or not text[stop:word].strip():
                start = word
    return out


def test_cut():
    rnd = random.Random(5)
    for k in range(900):
        text = "".join(rnd.choice(("abc.!? \t\n\n ", "abcdefgh ", "a漢\uffff", "a          ")[k % 4]) for _ in range(rnd.randrange(300)))
        size = rnd.randrange(4, 60)
        overlap, least = rnd.randrange(size // 2), rnd.randrange(10)
        assert cut(text, size, overlap, least) == slow_cut(text, size, overlap, least)
    with pytest.raises(ValueError):
        cut("x", 100, 50)


def covered(text, chunks):
    """Whether chunks found one after the other hold every character that isn't blank."""
    at = done = 0
    for c in chunks:
        at = text.index(c, at)
        if text[done:at].strip():
            return False
        done = max(done, at + len(c))
    return not text[done:].strip()


def test_nothing_is_lost():
    """Texts without blanks, of very long words, with rare blanks, of blanks nearly all, and with short ends."""
    rnd = random.Random(6)
    texts = ["漢" * 3000, "x" * 3000, " ".join("w" * 900 for _ in range(5)), "a\uffffb" * 700, "word " * 170 + "end", "ab" + " " * 2000 + "c" * 60, "x" * 801]
    for _ in range(200):
        texts.append("".join("".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(rnd.choice((1, 5, 40, 400, 1500)))) + rnd.choice((" ", "\n\n", "   ", ". ")) for _ in range(rnd.randrange(1, 14))))
    for text in texts:
        text = text.strip()
        # Characters told apart, so that a chunk is found only where it was cut.
        text = "".join(c if c.isspace() else chr(0x10000 + k) for k, c in enumerate(text))
        chunks = cut(text)
        assert covered(text, chunks) if len(text) >= 50 else chunks == [], text[:40]
        assert all(len(c) <= 800 for c in chunks)


def test_ids_apart(spark):
    """A digit at the end of a path and the number of a chunk don't run together."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a1", 1), ("a", 11), ("a11", None), ("a", 1)], "source_file string, chunk_index int")
    ids = df.select(ingest.record_id(F.lit("d"), F.lit("t"), F.col("source_file"), F.col("chunk_index")).alias("id")).collect()
    assert len({r["id"] for r in ids}) == 4


def test_project(spark, tmp_path):
    root, body = tmp_path / "p", "The api answers requests with words.\n" * 60
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "a.md").write_text(body)
    (root / "b.txt").write_text("the api, the api and one more line of plain words about nothing else at all")
    (root / "short.txt").write_text("short")
    (root / "bad.txt").write_bytes(b"\xff" + body.encode())
    table = VersionedTable(spark, str(tmp_path / "t"))
    rooms = {"docs": ["guide"], "backend": ["api"]}
    read = lambda: ingest.ingest_project(spark, str(root), table, "acme", rooms, "me")
    assert read() == 1
    rows = table.read().collect()
    assert {(r["source_file"], r["topic"]) for r in rows} == {("docs/a.md", "docs"), ("b.txt", "backend"), ("bad.txt", "backend")}
    assert [r["document"] for r in sorted((r for r in rows if r["source_file"] == "docs/a.md"), key=lambda r: r["chunk_index"])] == cut(body)
    assert len({r["id"] for r in rows}) == len(rows) and read() is None
    (root / "b.txt").write_text("words about a guide, long enough to be a record of its own, and newer than it was")
    import os

    os.utime(root / "b.txt", (2_000_000_000, 2_000_000_000))
    assert read() == 2
    now = [r for r in table.read().collect() if r["source_file"] == "b.txt"]
    assert len(now) == 1 and now[0]["topic"] == "docs" and table.read().count() == len(rows)


def test_conversations(spark):
    text = "> how is the code?\nThe code is fine, it has no bug and compiles at once.\n\n> and the next one?\nIt is fine as well, the code has been tested.\n\n> good\nYes, all of the code is good by now."
    df = spark.createDataFrame([("c1", text), ("c2", None), ("c3", "")], "path string, text string")
    rows = ingest.conversation_records(df, "acme", {"technical": ["code", "bug"]}, "me").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == [0, 1, 2] and {(r["source_file"], r["topic"]) for r in rows} == {("c1", "technical")}
    assert rows[0]["document"].startswith("> how is the code?")


def test_queries(spark, sf_dir):
    """Each long document that no rule rejects has its chunks, and records of both queries have ids of their own."""
    from lorekeep.functions.probes import file_rejection
    from lorekeep.plans import registry

    rows = registry.queries()["ingest_documents"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("concat(source, '/', doc_id, '.txt') AS path", "text")
    good = docs.where("length(trim(text)) >= 50").select("path", "text", file_rejection(docs["text"], docs["path"]).alias("why")).where("why IS NULL").collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["chunk_index"]):
        found.setdefault(r["source_file"], []).append(r["document"])
    assert found == {r["path"]: cut(r["text"]) for r in good if cut(r["text"])} and found
    talks = registry.queries()["ingest_conversations"](spark, sf_dir).collect()
    assert talks and len({r["id"] for r in talks}) == len(talks) and len({r["id"] for r in rows}) == len(rows)
