"""Names, rooms, boosts, times and digests on made-up values."""

from pyspark.sql import functions as F

from lorekeep.functions import boosts as B
from lorekeep.functions import names as N
from lorekeep.operators import diary as D
from lorekeep.operators import retrieval as R


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(rows)], "k int, a string, b string" if isinstance(rows[0], tuple) else "k int, a string").orderBy("k").select(column).collect()]


def test_names(spark):
    assert values(spark, N.name_error(F.col("a")), "notes of May", " ", None, "x" * 129, "a/b", "a..b", "-x", "O'Hara-2.x") == [None, "empty", "empty", "too long", "path", "path", "characters", None]
    assert values(spark, N.hinted(F.col("a"), {"src": "code", "src/web": "web"}), "/home/SRC/web/x", "/src/y", "z", None) == ["web", "code", None, None]
    assert values(spark, N.personas(F.col("a")), "Ann: hi\nuser: I am Bob now\nAnn: yes, call me Ann", "", None) == [["Ann", "Bob"], [], None]


def test_rooms(spark):
    rooms = {"frontend": ["web"], "billing": ["invoice"]}
    rows = [("web-app/src/a.py", "invoice"), ("src/billing.v2.md", "web"), ("interviews/x.md", "an invoice, a web, an Invoice"), ("x.md", "nothing"), ("x.md", None)]
    assert values(spark, N.room_of(F.col("a"), F.col("b"), rooms), *rows) == ["frontend", "billing", "billing", "general", "general"]
    far = [("x.md", " " * 2000 + "invoice"), ("y.md", "invoice")]
    assert values(spark, N.room_of(F.col("a"), F.col("b"), rooms), *far) == ["general", "billing"]
    assert values(spark, N.room_of(F.col("a"), F.col("b"), rooms, head=None), *far) == ["billing", "billing"]


def test_questions(spark):
    asked = ('Did Ann say "blue door" or \'ok\'?', "blue Door, ann")
    assert values(spark, B.quoted(F.col("a")), asked) == [["blue door"]]
    assert values(spark, B.person_names(F.col("a")), asked) == [["Ann"]]
    assert values(spark, B.share(B.quoted(F.col("a")), F.col("b")), asked, ("none", "x"), ("'a phrase'", None)) == [1.0, 0.0, 0.0]
    assert values(spark, B.normal_answer(F.col("a")), "The cat, and a  Dog!", "an 1,000", "", None) == ["the cat dog", "1000", "", None]
    assert values(spark, B.session_of(F.col("a")), "s_1_turn_2", "s_turn_1_turn_9", "s_3") == ["s_1", "s_turn_1", "s_3"]
    assert values(spark, B.overlaps(F.col("a"), F.col("b")), ("Big cat", "cat "), ("cat", "a cat"), ("", "cat"), ("dog", "cat"), (None, "x")) == [True, True, False, False, False]


def test_times(spark):
    assert values(spark, N.utc_micros(F.col("a")), "1970-01-01T00:00:01Z", "1970-01-01T01:00:00+01:00", "1970-01-02", "1970-01-01T00:00:02", "no time") == [1_000_000, 0, 86_400_000_000, 2_000_000, None]
    assert values(spark, N.utc_micros(F.col("a")), "", None) == [-(2**63) + 1] * 2


def test_trim(spark):
    short, many, wide = "a\nb", "\n".join("x" * 3 for _ in range(300)), "\n".join("é" * 6000 for _ in range(4))
    got = values(spark, D.trim(F.col("a")), short, many, wide, "y" * 30_000, None)
    assert got[0] == short and got[1] == "\n".join(["xxx"] * 198) + D.CUT and got[2] == "\n".join(["é" * 6000] * 2) + D.CUT
    assert got[3] == D.CUT and got[4] is None


def test_lexical_score(spark):
    score = R.lexical_score(F.col("a"), ["the", "blue", "door"], ("house",))
    assert values(spark, score, "A blue house", "the the", None, "BLUE door house") == [0.6, 0.0, 0.0, 1.0]
    assert values(spark, R.lexical_score(F.col("a"), ["the"]), "the") == [0.0]


def test_phrases_lose_blanks_alone(spark):
    """Blanks at the ends of a phrase go, and no digit that is its place among the phrases."""
    assert values(spark, B.quoted(F.col("a")), "'0 first ' and ' 1second 1' \"2third \"") == [["0 first", "1second 1", "2third"]]
