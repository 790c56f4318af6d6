import pytest

from lorekeep.sources.versions import Conflict, VersionedTable


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, document string, source_file string, domain string")


def content(table):
    return sorted((r["id"], r["document"]) for r in table.read().collect())


def test_changes(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), {"model": "m1"})
    assert t.versions() == []
    with pytest.raises(LookupError):
        t.read()
    assert t.upsert(rows(spark, ("1", "a", "f", "d"), ("1", "b", "f", "d"), ("2", "c", "g", "d")), "document") == 1
    assert content(t) == [("1", "b"), ("2", "c")]
    t.upsert(rows(spark, ("2", "x", "g", "d"), ("3", "y", "g", "d")).drop("domain"), "document")
    assert content(t) == [("1", "b"), ("2", "x"), ("3", "y")]
    t.add_if_absent(rows(spark, ("3", "no", "h", "d"), ("4", "new", "h", "d")))
    t.update(spark.createDataFrame([("1", "patched"), ("9", "nobody")], "id string, document string"))
    t.delete(spark.createDataFrame([("3",), ("8",)], "id string"))
    assert content(t) == [("1", "patched"), ("2", "x"), ("4", "new")]
    t.replace_sources(rows(spark, ("7", "again", "h", "d")))
    assert content(t) == [("1", "patched"), ("2", "x"), ("7", "again")]
    assert sorted(r[0] for r in t.read(1).select("id").collect()) == ["1", "2"]
    assert t.vacuum(keep=2) == 4 and t.versions() == [5, 6]
    with pytest.raises(ValueError):
        VersionedTable(spark, t.root, {"model": "m2"}).read()


def test_conflict_and_empty(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(rows(spark), 0)
    assert content(t) == []
    with pytest.raises(Conflict):
        t.write(rows(spark, ("1", "a", "f", "d")), 0)
    assert content(t) == []


def test_upsert_changed(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    make = lambda *v: spark.createDataFrame(list(v), "id string, source_file string, content_hash string, n int")
    t.write(make(("1", "a", "h1", 0), ("2", "b", "h2", 0)))
    t.upsert_changed(make(("1", "a", "h1", 9), ("2", "b", "h3", 9), ("3", "c", None, 9)))
    assert sorted((r["id"], r["n"]) for r in t.read().collect()) == [("1", 0), ("2", 9), ("3", 9)]


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_writes_follow_the_change(spark, tmp_path):
    """One row changed writes its bucket, an added row itself; other folders are named by both versions."""
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=50)
    t.write(spark.range(20_000).selectExpr("cast(id AS string) AS id", "sha2(cast(id AS string), 256) AS document", "'f' AS source_file", "'d' AS domain"), 0)
    before = size(tmp_path)
    t.upsert(rows(spark, ("77", "new", "f", "d")), "document")
    t.delete(spark.createDataFrame([(78,)], "id long"))
    t.update(spark.createDataFrame([("79", "patched")], "id string, document string"))
    changed = size(tmp_path / "t") - before
    assert changed < 3 * before / 25
    t.add_if_absent(rows(spark, ("77", "no", "f", "d"), ("more", "yes", "f", "d")))
    assert size(tmp_path / "t") - before - changed < 5_000
    found = dict(content(t))
    assert len(found) == 20_000 and found["77"] == "new" and found["79"] == "patched" and found["more"] == "yes" and "78" not in found
    assert t.compact(folders=2) == 6 and t.compact(folders=2) is None and dict(content(t)) == found
    assert t.vacuum(keep=1) == 5 and dict(content(t)) == found and size(tmp_path / "t") < 1.1 * before


def test_state(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(rows(spark, ("1", "a", "f", "d")), state={"vector": {"n": 3}})
    t.upsert(rows(spark, ("2", "a", "f", "d")), "document")
    t.set_state({"vector": {"n": 4}})
    assert t.state() == {"vector": {"n": 4}} and t.state(2) == {"vector": {"n": 3}} and len(content(t)) == 2
