import random
import re

from pyspark.sql import functions as F

from lorekeep.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(token, words):
    limit = 2 if len(token) <= 7 else 3
    near = [(d, -n, w) for w, n in words.items() if (d := distance(token, w)) <= limit]
    return min(near)[2] if near else None


def test_like_all_pairs(spark):
    rng = random.Random(8)
    make = lambda: "".join(rng.choices("abcde", k=rng.randrange(4, 13)))
    words = {make(): rng.randrange(3, 9) for _ in range(250)}
    tokens = {make() for _ in range(250)}
    for w in list(words)[:150]:
        t = list(w)
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice(("", "x", "a", "bc"))
        tokens.add("".join(t) or "aaaa")
    df = spark.createDataFrame(list(words.items()), "word string, times long")
    got = dict(map(tuple, spelling.corrections(spark.createDataFrame([(t,) for t in tokens], "word string"), df).collect()))
    want = {t: c for t in tokens if len(t) >= 4 and t not in words and (c := brute(t, words))}
    assert got == want and len(want) > 100


def test_rules(spark):
    alone = ["hi", "3am", "top10", "bge-large-v1.5", "ChromaDB", "NDCG", "MAX_RESULTS", "train_test", "https://example.com", "www.google.com", "`code`", "**bold**", "~/x/file", "notes.txt", "Riley", "Élan"]
    df = spark.createDataFrame([(w,) for w in [*alone, "hello", "question", "naïve"]], "word string")
    assert [r[0] for r in df.where(~spelling.left_alone(F.col("word"))).collect()] == ["hello", "question", "naïve"]


def test_texts(spark):
    words = spark.createDataFrame([("know", 9), ("before", 9), ("question", 5), ("really", 4), ("hard", 3)], "word string, times long")
    names = spark.createDataFrame([("Befor",)], "name string")
    rows = [(1, "I knoe  the questoin,\tbefor!\n", 0), (2, None, 0), (3, "", 0), (4, " ", 0), (5, "Knoe realy hrad? (befor) 3am", 0), (6, "realy " * 20_000, 0)]
    df = spark.createDataFrame(rows, "id long, document string, word int")
    got = {r[0]: r[1] for r in spelling.corrected(df, words).collect()}
    assert got == {1: "I know  the question,\tbefore!\n", 2: None, 3: "", 4: " ", 5: "Knoe really hard? before) 3am", 6: "really " * 20_000}
    kept = {r[0]: r[1] for r in spelling.corrected(df, words, names).collect()}
    assert kept[1] == "I know  the question,\tbefor!\n"
    assert spelling.corrected(df.limit(0), words).count() == 0 and spelling.corrected(df, words.limit(0)).count() == 6


def test_transcripts(spark):
    words = spark.createDataFrame([("know", 9), ("before", 9)], "word string, times long")
    text = "I knoe\n> I knoe  befor\n\n  > knoe\nknoe > befor\n>\n>knoe"
    df = spark.createDataFrame([(1, text), (2, None), (3, "knoe")], "id long, document string")
    got = {r[0]: r[1] for r in spelling.corrected_transcripts(df, words).collect()}
    assert got == {1: "I knoe\n> I know  before\n\n  > know\nknoe > befor\n>\n>knoe", 2: None, 3: "knoe"}
    assert re.sub(r"know", "knoe", got[1]).count("\n") == text.count("\n")


def test_dictionary(spark):
    df = spark.createDataFrame([("word word, Word wörd wörd wörd x_word word1 word",), (None,)], "document string")
    assert {tuple(r) for r in spelling.dictionary(df).collect()} == {("word", 3), ("wörd", 3)}


def test_common_heads(spark):
    """Words that begin alike meet by what tells them apart, not each with each; more edits are tried only for what fewer don't mend."""
    rng = random.Random(5)
    tail = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    words = {"through" + tail(): rng.randrange(3, 9) for _ in range(300)}
    tokens = {"through" + tail() for _ in range(100)} - set(words)
    df = spark.createDataFrame(list(words.items()), "word string, times long")
    asked = spark.createDataFrame([(t,) for t in tokens], "word string")
    index = spelling._deletions(df, 3).withColumnRenamed("word", "correct")
    assert spelling._deletions(asked, 3).join(index, "key").select("word", "correct").distinct().count() < 0.3 * len(words) * len(tokens)
    want = {t: c for t in tokens if (c := brute(t, words))}
    assert dict(map(tuple, spelling.corrections(asked, df).collect())) == want and want


def test_keys_are_not_broadcast(spark, monkeypatch):
    """Deletions of the tokens and of the dictionary meet by a shuffle at any size: a driver has no room for either."""
    plans, store = [], spelling.store
    note = lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or store(df, name)
    monkeypatch.setattr(spelling, "store", note)
    words = spark.createDataFrame([("question", 5), ("really", 4), ("wonderful", 3)], "word string, times long")
    asked = spark.createDataFrame([("questoin",), ("realy",), ("wodnerfull",), ("xxxxxxxx",)], "word string")
    assert dict(map(tuple, spelling.corrections(asked, words).collect())) == {"questoin": "question", "realy": "really", "wodnerfull": "wonderful"}
    near = [plan for name, plan in plans if name == "spelling-near"]
    assert len(near) == 3 and all(re.search(r"SortMergeJoin \[key#", p) and not re.search(r"BroadcastHashJoin \[key#", p) for p in near)


def test_map_of_keys(spark):
    """Keys that share a row of the map, and those of either sign, are told apart."""
    keys = [0, 1, 63, 64, -1, -64, 2**63 - 1, -(2**63), 1 << 46, (1 << 46) + 1, -(1 << 46)]
    asked = spark.createDataFrame([("a", k) for k in keys[::2]], "word string, key long")
    index = spark.createDataFrame([("b", k) for k in keys] * 2, "correct string, key long")
    assert sorted(r["key"] for r in spelling._met(asked, index).collect()) == sorted(keys[::2] * 2)
