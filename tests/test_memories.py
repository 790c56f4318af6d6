import random
import re

from pyspark.sql import functions as F

from lorekeep.functions import memories as M
from lorekeep.functions import summary as S
from lorekeep.functions.search_text import sanitize
from lorekeep.operators import chunks as K


def column(spark, texts, expression):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, document string").repartition(2)
    return [r[1] for r in df.select("id", expression(F.col("document")).alias("x")).orderBy("id").collect()]


def test_segments(spark):
    turns = "intro\n> one\nreply\nUser: two\nAI : three\nrest"
    long = "\n".join(f"line {k}" for k in range(30))
    got = column(spark, [turns, " a\n\n\n\nb ", long, "", None], M.segments)
    assert got[0] == ["intro", "> one\nreply", "User: two", "AI : three\nrest"]
    assert got[1] == ["a", "b"] and len(got[2]) == 2 and got[2][1].startswith("line 25")
    assert got[3] == [] and got[4] in (None, [])


def test_prose(spark):
    text = "Some words here.\n```\ncode inside\n```\nimport os\nx = a.b\nMore words.\n{\n12345 67890 !!!!\n``` \nopen fence"
    assert column(spark, [text, "import os", ""], M.prose) == ["Some words here.\nMore words.", "import os", ""]


def test_memories(spark):
    rows = [
        (1, "We decided to use the new framework because it is better than the old one.\n\nshort\n\nI prefer tabs; always use tabs, never use spaces."),
        (2, "There was a bug and an error in the crash handler, an issue.\n\nThe bug was an error, a crash; now it is resolved."),
        (3, "nothing to be seen in this line of words at all"),
        (4, None),
        (5, ""),
    ]
    df = spark.createDataFrame(rows, "id int, document string")
    got = [(r["id"], r["chunk_index"], r["kind"]) for r in M.memories(df).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, "decision"), (1, 1, "preference"), (2, 0, "problem"), (2, 1, "milestone")]


def test_summary(spark):
    text = "Yesterday Alice decided to replace the database because GraphQL was slow. It was fine. Bob agreed with GraphQL."
    line, empty, none = column(spark, [text, "", None], S.compact)
    assert line == '0:ALI+BOB|graphql_alice_bob|"Yesterday Alice decided to replace the database beca..."|determ|DECISION+TECHNICAL' or line.startswith("0:ALI+BOB|graphql_")
    assert empty == "0:???|misc" and none is None
    assert column(spark, [text], lambda c: S.name_codes(c, {"Alice": "ALC", "bob": "B"})) == [["ALC"]]
    assert column(spark, ["one two three four", "", " "], S.token_estimate) == [5, 1, 1]


def test_topics_by_counting(spark, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    want = []
    for t in texts:
        weights = {}
        for w in re.findall(r"[a-zA-Z][a-zA-Z_-]{2,}", t or ""):
            if w.lower() not in S.STOP:
                odd = "_" in w or "-" in w or w[1:] != w[1:].lower()
                weights[w.lower()] = weights.get(w.lower(), 0) + 1 + 2 * w[0].isupper() + 2 * odd
        want.append(sorted(weights, key=lambda w: -weights[w])[:3])
    assert column(spark, texts, S.topics) == want


def test_sanitize(spark):
    prompt = "You are an assistant that follows rules. " * 8
    cases = [
        ("  short one ", ("short one", "passthrough")),
        (prompt + "\nQuery: where is the fish market", ("where is the fish market", "labeled_tail")),
        (prompt + "<query>first of these</query> <query>second of these</query>", ("second of these", "labeled_tail")),
        (prompt + "\nWhat is the answer?\nthanks", ("What is the answer?", "question_extraction")),
        (prompt + "\nfind all of the fish\nok", ("find all of the fish", "tail_sentence")),
        ("x\n" * 300, (("x\n" * 300).strip()[-500:].strip(), "tail_truncation")),
        (None, ("", "passthrough")),
        ("", ("", "passthrough")),
    ]
    got = column(spark, [c for c, _ in cases], sanitize)
    assert [(g["clean_query"], g["method"]) for g in got] == [w for _, w in cases]


def test_chunks(spark):
    words = " ".join(f"word{k}" for k in range(600))
    text = words[:500] + "\n\n" + words[500:1100] + ". Next " + words[1100:]
    found = K.cut(text)
    assert found[0] == text[:500].strip() and max(map(len, found)) <= 800
    assert set(text.split()) == set(" ".join(found).split()) | {text[:500].split()[-1], text[502:].split()[0]}
    assert K.cut("a" * 2000)[0] == "a" * 800 and K.cut("") == [] and K.cut("tiny") == []
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, document string")
    assert [r["content"] for r in K.chunks(df).orderBy("chunk_index").collect()] == found


def test_exchange_units(spark):
    talk = "before\n> " + "question " * 6 + "\n  answer\n\nmore\n\n---\nlost\n> short\n> " + "second " * 200
    got, plain, none = column(spark, [talk, "x" * 40 + "\n\n" + "y" * 10, None], K.exchange_units)
    assert got[0] == ("> " + "question " * 6).strip() + "\n  answer\n\nmore"
    assert "".join(got[1:]) == ("> " + "second " * 200).strip() and plain == ["x" * 40] and not none


def test_characters_that_mark_nothing(spark):
    """The last code points of the plane are characters like others to noise, exchanges and segments."""
    from pyspark.sql import functions as F

    from lorekeep.functions.memories import segments
    from lorekeep.functions.noise import strip_noise
    from lorekeep.operators.chunks import exchange_units

    odd = "a ￿ b ￾0 ￾1 ￾"
    texts = [odd, f"<command-name>x</command-name>\n{odd}", f"Daily auto-save checkpoint.\n{odd}", f"SomeApp auto-save checkpoint.\n{odd}", f"> one {odd}\nanswer {odd}\n> two\nb\n> three\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strip_noise(F.col("t"))).collect()]
    assert got == [odd, odd, texts[2], odd, texts[4]]
    assert df.select(exchange_units(F.col("t"), least=0)).collect()[4][0] == [f"> one {odd}\nanswer {odd}", "> two\nb", "> three\nc"]
    assert df.select(segments(F.col("t"))).collect()[4][0] == [f"> one {odd}\nanswer {odd}", "> two\nb", "> three\nc"]


def test_needles(spark):
    """No pattern hits a text without its needles, and hits are those of the patterns alone."""
    rng = random.Random(4)
    texts = []
    for pattern in (m for kind in M.MARKERS.values() for m in kind):
        for _ in range(4):
            text = re.sub(r"\(([^()]*)\)\?", lambda g: rng.choice(["", rng.choice(g[1].split("|"))]), pattern)
            text = re.sub(r"\(([^()]*)\)", lambda g: rng.choice(g[1].split("|")), text)
            text = re.sub(r"\[\^\*\]\+", "so", re.sub(r"([a-z'_-])\?", lambda g: rng.choice(["", g[1]]), text).replace(".*", " x "))
            text = text.replace(r"\b", "").replace(r"\d", "7").replace("7+", "12").replace("\\", "")
            text += "so" if text.endswith(" ") else ""
            assert re.search(pattern, text), (pattern, text)
            assert all(any(x in text for x in f) for f in M.needles(pattern)), (pattern, text)
            texts.append(text)
    texts += [" ".join(rng.choices(texts, k=6)) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    for kind, patterns in M.MARKERS.items():
        got = [tuple(r) for r in df.select("t", M.marker_hits(F.col("t"), kind)).collect()]
        assert got == [(t, None if t is None else sum(len(re.findall(m, t)) for m in patterns)) for t, _ in got]
    assert sum(bool(M.needles(m)) for kind in M.MARKERS.values() for m in kind) >= 115


def test_summary_evaluates_once(spark):
    """Words, sentences and lower-case texts are each mentioned once: in branches and lambdas each mention is evaluated."""
    plan = spark.createDataFrame([], "d string").select(S.compact(F.col("d")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == plan.count("[.!?") == 1
    assert plan.count("lower(d#") == 2  # of moods and of flags
