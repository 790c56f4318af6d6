"""Exports skip files before they are opened; a legacy store becomes a table."""

import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lorekeep.sources import readers
from lorekeep.sources.versions import VersionedTable


def test_files_are_skipped(tmp_path):
    """Which files a partition names, without Spark: filters decide before a file is opened."""
    for name, text in {"a/x.txt": "one", "a/y.md": "two two", "b/z.txt": "three", "b/z.meta.json": "{}", "b/q.bin": "no", "b/Q.JSON": "{}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)

    def left(*filters, **options):
        reader = readers.ExportReader({"path": str(tmp_path), **options})
        rest = list(reader.pushFilters(list(filters)))
        return [[f[0][len(str(tmp_path)) + 1 :] for f in p.files] for p in reader.partitions()], rest

    assert left() == ([["a/x.txt", "a/y.md", "b/Q.JSON", "b/z.txt"]], [])
    assert left(D.StringStartsWith(("path",), f"{tmp_path}/a/"))[0] == [["a/x.txt", "a/y.md"]]
    assert left(D.EqualTo(("path",), f"{tmp_path}/b/z.txt"), D.IsNotNull(("path",)))[0] == [["b/z.txt"]]
    assert left(D.GreaterThan(("size",), 4))[0] == [["a/y.md", "b/z.txt"]] and left(D.In(("size",), (3, 7)))[0] == [["a/x.txt", "a/y.md"]]
    assert left(partitionBytes="7")[0] == [["a/x.txt"], ["a/y.md"], ["b/Q.JSON", "b/z.txt"]] and left(suffixes=".bin")[0] == [["b/q.bin"]]
    other = [D.StringContains(("content",), "o"), D.Not(D.EqualTo(("path",), "x")), D.EqualTo(("path",), None)]
    files, rest = left(*other)
    assert len(files[0]) == 4 and all(a is b for a, b in zip(rest, other, strict=True))
    assert left(D.StringEndsWith(("path",), "none"))[0] == [[]]


def test_exports(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("héllo".encode() + b"\xff")
    (tmp_path / "b.md").write_text("")
    (tmp_path / "c.jsonl").write_text("{}\n" * 5)
    df = readers.exports(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    assert sorted((r["name"], r["size"], r["content"]) for r in df.collect()) == [("b.md", 0, ""), ("c.jsonl", 15, "{}\n" * 5), ("x.txt", 7, "héllo�")]
    some = readers.exports(spark, f"file://{tmp_path}", F.col("path").contains("/a/") & F.col("content").contains("llo"))
    assert [r["size"] for r in some.collect()] == [7]
    assert readers.exports(spark, str(tmp_path), F.col("size") > 99).count() == 0


def test_legacy(spark, tmp_path):
    path = tmp_path / "old.sqlite3"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE embeddings (id INTEGER PRIMARY KEY, embedding_id TEXT)")
    db.execute("CREATE TABLE embedding_metadata (id INTEGER, key TEXT, string_value TEXT, int_value INTEGER, float_value REAL, bool_value INTEGER)")
    for k in range(1, 1001):
        db.execute("INSERT INTO embeddings VALUES (?, ?)", (3 * k, f"r{k}"))
        if k != 7:
            db.executemany(
                "INSERT INTO embedding_metadata VALUES (?, ?, ?, ?, ?, ?)",
                [(3 * k, "chroma:document", f"text {k}", None, None, None), (3 * k, "domain", "d", None, None, None), (3 * k, "n", None, k, None, None), (3 * k, "w", None, None, 0.5, None), (3 * k, "ok", None, None, None, 1), (3 * k, "chroma:own", "x", None, None, None), (3 * k, "none", None, None, None, None)],
            )
    db.commit()
    db.close()
    table = VersionedTable(spark, str(tmp_path / "table"), buckets=4)
    assert readers.migrate(spark, str(path), table, partitionIds=700) == 1000
    rows = {r["id"]: r for r in table.read().collect()}
    assert rows["r12"]["document"] == "text 12" and rows["r12"]["domain"] == "d" and rows["r12"]["topic"] is None
    assert rows["r12"]["metadata"] == {"n": "12", "w": "0.5", "ok": "true"} and rows["r7"]["document"] == "" and rows["r7"]["metadata"] == {}
    with pytest.raises(ValueError):
        readers.migrate(spark, str(path), table)
    empty = tmp_path / "empty.sqlite3"
    db = sqlite3.connect(empty)
    db.execute("CREATE TABLE embeddings (id INTEGER PRIMARY KEY, embedding_id TEXT)")
    db.execute("CREATE TABLE embedding_metadata (id INTEGER, key TEXT, string_value TEXT, int_value INTEGER, float_value REAL, bool_value INTEGER)")
    db.close()
    assert readers.legacy(spark, str(empty)).count() == 0
