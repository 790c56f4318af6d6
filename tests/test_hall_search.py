"""Two passes by hall against a loop over all sessions."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from lorekeep.functions import halls as H
from lorekeep.operators import hall_search as S
from lorekeep.operators import retrieval as R

HALLS = [H.PREFERENCES, H.ADVICE, H.EVENTS, H.FACTS, H.GENERAL]
WORDS = "tea boat river stone lamp garden winter paper music bread".split()


def tokens(text):
    return {t.lower() for t in re.findall("[A-Za-z0-9_]{2,}", text or "")}


def six(x):
    """To six places, halves up, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def loop(turns, halls, questions, k, narrow):
    out = []
    for query, question, asked in questions:
        words = tokens(question) - set(R.STOP_WORDS)
        share = lambda said: six(len(words & said) / len(words)) if words else 0.0  # noqa: E731, B023
        user = {c: set().union(*(tokens(t) for d, _, r, t in turns if d == c and r == "user")) for c in {t[0] for t in turns}}
        wide = sorted((-share(said), c) for c, said in user.items() if share(said) > 0)[:k]
        first = asked[0] if asked else None
        hits = set()
        if first not in (None, H.GENERAL):
            units = [(-share(said), c, -1) for c, said in user.items() if halls.get(c) == first]
            if first == H.ADVICE:
                units += [(-share(tokens(t)), c, n) for c, n, r, t in turns if r == "assistant" and t and len(t) > 30 and halls.get(c) == first]
            hits = {c for s, c, _ in sorted(u for u in units if u[0] < 0)[:narrow]}
        found = []
        for s, c in wide:
            hall = halls.get(c)
            bonus = 0.75 if hall == first and first not in (None, H.GENERAL) else 0.90 if hall in (asked or []) else 1.0
            found.append((six((1 + s) * (1 + 0.3 * s) * bonus * (0.85 if c in hits else 1.0)), c))
        out += [(query, c, c in hits, d, n) for n, (d, c) in enumerate(sorted(found), 1)]
    return sorted(out)


def test_against_a_loop(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    turns = [(c, n, "user" if n % 2 == 0 else "assistant", rng.choice([None, "", say(2), say(9), say(3)])) for c in range(60) for n in range(rng.randrange(1, 6))]
    halls = {c: rng.choice(HALLS) for c in range(55)}
    questions = [(q, say(4) + rng.choice([" the what", ""]), rng.sample(HALLS, rng.randrange(1, 4))) for q in range(12)] + [(20, "the what", [H.EVENTS]), (21, None, [H.FACTS]), (22, "tea boat", [])]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("token", F.lit("an extra column"))
    by = spark.createDataFrame(list(halls.items()), "id long, hall string").withColumn("turn", F.lit(1))
    asked = spark.createDataFrame(questions, "query_id long, question string, halls array<string>")
    for k, narrow in ((50, 10), (7, 2)):
        got = S.search(df, by, asked, k, narrow)
        assert sorted((r["query_id"], r["id"], r["confirmed"], r["distance"], r["rank"]) for r in got.collect()) == loop(turns, halls, questions, k, narrow)
    assert S.search(df.limit(0), by, asked).count() == 0 == S.search(df, by, asked.limit(0)).count()


def test_halls_of_texts(spark):
    """Halls read from the texts: a hit of the narrow pass is confirmed, a session of another hall isn't."""
    turns = [(1, 0, "user", "job tea river"), (2, 0, "user", "the job: my college degree, tea"), (1, 1, "assistant", "yes")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    asked = spark.createDataFrame([(9, "tea river of the job")], "query_id long, question string").withColumn("halls", H.question_halls(F.col("question")))
    halls = H.sessions(df).withColumnRenamed("conv_id", "id")
    got = S.search(df, halls, asked).collect()
    by = {r["id"]: r for r in got}
    assert by[2]["confirmed"] and not by[1]["confirmed"] and by[2]["hall"] == H.FACTS
