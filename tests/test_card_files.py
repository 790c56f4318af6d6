"""Catalog cards in files: a refresh equals a rebuild and writes only the domains of the change."""

from pathlib import Path

from pyspark.sql import functions as F

from lorekeep.operators import card_files as C

SCHEMA = "id string, document string, domain string, topic string, source_file string"


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in C.SCHEMA.replace(" bigint", "").split(", ") for c in [c.split()[0]]) for r in df.collect())))


def files(path):
    return {d.name: {f.name for f in d.glob("*.json")} for d in Path(path).glob("domain=*")}


def test_refresh_equals_rebuild(spark, tmp_path):
    at = str(tmp_path / "cards")
    before = spark.createDataFrame(
        [
            ("1", "Alpha beta beta about", "d", "t", "a.txt"),
            ("2", "Alpha Gamma", "d", None, None),
            ("3", None, "x/y z", "", "b.txt"),
            ("4", "stays as it was", "still", "t", "c.txt"),
            ("5", "no domain", None, "t", "c.txt"),
            ("6", "no domain", "", "t", "c.txt"),
        ],
        SCHEMA,
    ).withColumn("words", F.lit("an extra column"))
    C.rebuild(before, at)
    assert rows(C.load(spark, at)) == rows(C.cards(before))
    got = {(r["domain"], r["room"]): (r["topic"], r["entities"], r["records"]) for r in C.load(spark, at).collect()}
    assert got == {("d", "t"): ("beta alpha", ["Alpha"], 1), ("d", "general"): ("alpha gamma", ["Alpha", "Gamma"], 1), ("x/y z", "general"): ("general", [], 1), ("still", "t"): ("stays was", [], 1)}
    was = files(at)

    change = spark.createDataFrame([("1", "beta only", "d", "t", "a.txt"), ("7", "Delta", "new", "t", "a.txt"), ("8", "Alpha", "d", "", "")], SCHEMA)
    after = before.drop("words").where("id NOT IN ('1', '3')").unionByName(change)
    changed = before.drop("words").where("id IN ('1', '3')").unionByName(change)
    assert C.refresh(after, changed, at) == ["x/y z"]
    assert rows(C.load(spark, at)) == rows(C.cards(after))
    now = files(at)
    assert now["domain=still"] == was["domain=still"] and now["domain=d"] != was["domain=d"] and set(now) == {"domain=d", "domain=still", "domain=new"}
    assert C.refresh(after, changed, at) == [] and rows(C.load(spark, at)) == rows(C.cards(after))
    assert rows(C.load(spark, at, "new")) == rows(C.cards(after.where("domain = 'new'"))) and C.load(spark, at, "none").count() == 0


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    at = str(tmp_path / "cards")
    assert C.load(spark, at).count() == 0 and C.cards(none).count() == 0
    one = spark.createDataFrame([("1", "Alpha", "d", "t", "a")], SCHEMA)
    assert C.refresh(one, one, at) == [] and rows(C.load(spark, at)) == rows(C.cards(one))
    assert C.refresh(none, one, at) == ["d"] and C.load(spark, at).count() == 0
    assert C.refresh(none, none, at) == []
