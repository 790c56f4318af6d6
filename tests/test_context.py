"""Halls, tickets and names on cases written out."""

from pyspark.sql import functions as F

from lorekeep.functions import halls, people, tickets


def test_halls(spark):
    rows = [(1, 0, "user", "i"), (1, 1, "user", "prefer it"), (2, 0, "assistant", "I suggest"), (2, 1, "assistant", "here are"), (3, 0, "assistant", "I suggest"), (4, 0, "user", "My job"), (4, 1, "assistant", "which city"), (5, 0, "user", None), (6, 0, "user", "We moved")]
    found = dict(map(tuple, halls.sessions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert found == {1: halls.PREFERENCES, 2: halls.ADVICE, 3: halls.GENERAL, 4: halls.FACTS, 5: halls.GENERAL, 6: halls.EVENTS}
    asked = spark.createDataFrame([(1, "What You Told me"), (2, "when did we live there"), (3, None), (4, "my school")], "k int, q string")
    assert {r[0]: r[1] for r in asked.select("k", halls.question_halls(F.col("q"))).collect()} == {1: [halls.ADVICE, halls.GENERAL], 2: [halls.EVENTS, halls.FACTS, halls.GENERAL], 3: [halls.GENERAL], 4: [halls.FACTS, halls.GENERAL]}


def test_tickets(spark):
    rows = [(1, "T", "Map: #12\nreal\nBlocked by: #3\n", " done\n"), (2, None, None, None), (3, "T", "see Map: #4", " ")]
    df = spark.createDataFrame(rows, "k int, title string, body string, resolution string")
    got = df.select("k", tickets.ticket_text(F.col("title"), F.col("body"), F.col("resolution")), tickets.map_ref(F.col("body"))).collect()
    assert sorted(map(tuple, got)) == [(1, "# T\n\nreal\n\ndone", 12), (2, "# ", None), (3, "# T\n\nsee Map: #4", None)]
    urls = {"git@github.com:a/b.git": ("github", "a/b"), "https://forge.example:3000/x/y/z": ("gitea", "y/z"), "https://other.example/a/b": None, "github.com": None, "": None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] and tuple(r[1]) for r in df.select("url", tickets.remote_repo(F.col("url"), ("forge.example:22",))).collect()} == urls


def test_people(spark):
    texts = {"Mira: hello\nthen she left\nhey Mira": "person", "x\n\n\nshe": "uncertain", "building Mira\nimport Mira": "project", "Mira said. Mira said. Mira said": "uncertain", None: "uncertain"}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = people.signals(F.col("text"), "Mira")
    assert {r[0]: r[1] for r in df.select("text", people.classified(F.lit(3), counts)[0]).collect()} == texts
    far = spark.createDataFrame([("Mira\n\n\nshe",), ("Mira\n\nshe",)], "text string")
    assert [r[0] for r in far.select(people.signals(F.col("text"), "Mira")["pronoun"]).collect()] == [0, 1]
