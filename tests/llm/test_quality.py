import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import quality, registry, runtime


def figures(text):
    """The contract's figures and the verdict, word by word."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    n = len(w)
    failed = n < 20 or 100 * len(covered) > 30 * n
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)
    letters, capitals = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
    bad = 100 * symbols > 10 * n or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or chars < 2 * n or chars > 15 * n
    bad = bad or 100 * capitals > 50 * letters or 100 * sum(a == b for a, b in zip(w, w[1:])) > 20 * n
    return n, chars, symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and not bad


CASES = [
    None, "", " \t\n", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 50, "one two three four five six seven eight nine " * 40 + "end",
    "Line of words here\n" * 9, "A B C D E F G H I J K L M N O P Q R S T U V W", "## ** word | " * 30, "  no break \u0085 space" * 12, "é" * 900,
    " ".join(f"w{i % 9}" for i in range(60)), " ".join(f"word{i}" for i in range(3000)) + " " + " ".join(f"word{i}" for i in range(40)),
]


def report(df):
    return sorted((tuple(r) for r in quality.quality_report(df).select("doc_id", *quality.REPORT[:-1]).collect()), key=str)


def test_cases(spark):
    rng = random.Random(1)
    texts = CASES + [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 5, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept boolean")
    assert report(df) == sorted(((i, *figures(t)) for i, t in enumerate(texts)), key=str)
    assert sorted(r[0] for r in quality.keep_good(df).collect()) == [i for i, t in enumerate(texts) if figures(t)[-1]]
    assert quality.keep_good(df).columns == df.columns


def test_whole_table(spark, sf_dir):
    texts = {r[0]: r[1] for r in runtime.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in registry.op10_quality_cascade(spark, sf_dir).collect():
        assert tuple(r[1:]) == figures(texts[r["doc_id"]])


def test_order_changes_nothing(spark, sf_dir):
    docs = runtime.table(spark, sf_dir, "documents")
    marked = [quality.cascade(docs.withColumn(quality.TEXT, docs["text"]), rules).select("doc_id", "__q_rejected_by").collect() for rules in (quality.RULES, quality.RULES[::-1])]
    kept = [sorted(r[0] for r in rows if r[1] is None) for rows in marked]
    assert kept[0] == kept[1] and 0 < len(kept[0])
    stats = [quality.RuleStats(r, share, cost) for r, share, cost in zip(quality.RULES, (0.1, 0.5, 0.2, 0.0, 0.5), (1, 1, 0.1, 0.1, 2), strict=True)]
    assert [r.name for r in quality.ordered(stats)] == ["word_length", "dup_lines", "stutter", "symbols", "capitals"]


def test_edges(spark):
    df = spark.createDataFrame([(None, "a " * 30), (1, None), (1, None)], "doc_id long, text string")
    assert [r["kept"] for r in quality.quality_report(df).collect()] == [False] * 3
    assert quality.quality_report(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    """Names of helpers and figures in the input: the former pass through, the latter give way in the report only."""
    df = spark.createDataFrame([(1, "word " * 5, "w", 7, True, "t")], "doc_id long, text string, __q_words string, __q_n_words int, kept boolean, __q_text string")
    row = quality.quality_report(df).collect()[0].asDict()
    assert row["__q_words"] == "w" and row["__q_n_words"] == 7 and row["__q_text"] == "t" and row["kept"] is False and row["n_words"] == 5
    good = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30)), "w", 7, True, "t")], df.schema)
    assert [tuple(r) for r in quality.keep_good(good).collect()] == [tuple(r) for r in good.collect()]


def test_rejected_rows_are_not_looked_at(spark, monkeypatch):
    """A feature that only a later rule needs is not evaluated for a row that an earlier one rejected: here it would fail."""
    fails = lambda df, alive: df.withColumn(quality.P + "bomb", F.when(alive, F.when(F.length(quality.TEXT) < 30, F.raise_error(F.lit("looked at"))).otherwise(1)))
    monkeypatch.setitem(quality.FEATURES, "bomb", (fails, ()))
    later = quality.Rule("bomb", ("bomb",), lambda: F.col(quality.P + "bomb") < 0)
    df = spark.createDataFrame([(1, "too few"), (2, " ".join(f"word{i}" for i in range(30)))], "doc_id long, text string").withColumn(quality.TEXT, F.col("text"))
    got = quality.cascade(df, (quality.FEW_WORDS, later)).collect()
    assert [r["__q_rejected_by"] for r in got] == ["few_words", None]
    with pytest.raises(Exception, match="looked at"):
        quality.cascade(df, (later, quality.FEW_WORDS)).collect()


def test_sample_and_order(spark, sf_dir):
    """The sample is the same whatever the order and the files, spans all of them, and finds the shares of rejection."""
    docs = runtime.table(spark, sf_dir, "documents").select("text")
    one, two = (sorted(r[0] for r in quality.sample(d, "text", 40).collect()) for d in (docs, docs.repartition(7).orderBy(F.desc("text"))))
    assert one == two and 10 < len(one) < 100
    stats = quality.measure(docs, "text", quality.BASE_RULES + quality.RULES, 10_000)
    texts = {r[0] or "" for r in docs.collect()}
    assert stats[0].rejection == sum(figures(t)[0] < 20 for t in texts) / len(texts)
    assert all(s.seconds >= 0 for s in stats) and sum(s.seconds for s in stats) > 0
    empty = quality.measure(docs.limit(0), "text", quality.RULES)
    assert [s.rejection for s in empty] == [0.0] * len(quality.RULES)
