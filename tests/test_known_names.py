import random
import re

import pytest

from lorekeep.operators import known_names as K


@pytest.fixture(scope="module")
def registry(spark):
    people = spark.createDataFrame([("Riley", "daughter", "personal"), ("Maxwell", "friend", "work"), ("Grace", None, None), ("Anna Lee", "", "work"), (" ", "", ""), (None, "", ""), ("Riley", "daughter", "personal")], "name string, relationship string, context string")
    projects = spark.createDataFrame([("Harbour",), ("harbour.io",), ("",), (None,)], "name string")
    aliases = spark.createDataFrame([("Max", "Maxwell"), ("Maxi", "Maxwell"), ("Nobody", "Unknown")], "alias string, name string")
    return K.seeded(people, projects, aliases).cache()


def test_seed(registry):
    rows = {r["name"]: r for r in registry.collect()}
    assert set(rows) == {"Riley", "Maxwell", "Max", "Grace", "Anna Lee", "Harbour", "harbour.io"} and registry.count() == 7
    assert rows["Maxwell"]["aliases"] == ["Max"] and rows["Max"]["aliases"] == ["Maxwell"] and rows["Max"]["relationship"] == "friend"
    assert {n for n, r in rows.items() if r["ambiguous"]} == {"Max", "Grace"} and rows["Harbour"]["kind"] == "project"


def test_people(spark, registry):
    texts = ["I saw Riley and anna  lee", "anna lee's plan", "Grace said hello", "the grace of it", "Rileys and Riley_1, harbour", "hey max, MAXWELL is here", "to the max", None, "", "x" * 200_000 + " riley", "İ Riley"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, document string").repartition(3)
    got = {}
    for r in K.people_in(df, registry).collect():
        got.setdefault(r["id"], set()).add(r["name"])
    assert got == {0: {"Riley"}, 1: {"Anna Lee"}, 2: {"Grace"}, 5: {"Max", "Maxwell"}, 9: {"Riley"}, 10: {"Riley"}}
    assert K.people_in(df, registry.limit(0)).count() == 0 == K.people_in(df.limit(0), registry).count()


def test_like_single_patterns(spark, monkeypatch):
    """All names in one pass, also in blocks, against one regular expression for each name; and the votes against each pattern."""
    rng = random.Random(9)
    names = sorted({"".join(rng.choices("abé", k=rng.randrange(1, 4))) for _ in range(40)} | {"a b", "b.a"})
    texts = ["".join(rng.choices(["a", "b", "é", " ", ".", "_", "1", " said ", "with ", " of ", "the ", "'s"], k=rng.randrange(30))) for _ in range(400)]
    reg = spark.createDataFrame([(n, "person", [], "s", 1.0, [], "", n < "b") for n in names], K.REGISTRY)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, document string")
    want = set()
    for k, t in enumerate(texts):
        for n in names:
            if re.search(rf"\b{re.escape(n)}\b", t, re.IGNORECASE):
                count = lambda ps, n=n, t=t: sum(re.search(p.replace("@", re.escape(n)), t) is not None for p in ps) if n < "b" else 0
                want.add((k, n, count(K.FOR), count(K.AGAINST)))
    assert any(w[2] for w in want) and any(w[3] for w in want)
    for most in (200_000, 7):
        monkeypatch.setattr(K, "NAMES", most)
        assert set(map(tuple, K.mentions(df, reg).collect())) == want


def test_lookup(spark, registry):
    words = [("riley", ""), ("Grace", "Grace said so and Grace is glad"), ("Grace", "the grace of god"), ("Grace", "grace"), ("Grace", None), ("harbour", "x"), ("Zed", "x"), ("max", "the max at noon"), (None, None)]
    df = spark.createDataFrame(words, "word string, context string")
    got = {(r["word"], r["context"]): (r["kind"], r["confidence"], r["source"], r["name"], r["decided"]) for r in K.looked_up(df, registry).collect()}
    assert got == {
        ("riley", ""): ("person", 1.0, "onboarding", "Riley", False),
        ("Grace", words[1][1]): ("person", 0.95, "onboarding", "Grace", True),
        ("Grace", "the grace of god"): ("concept", 0.8, "context_disambiguated", "Grace", True),
        ("Grace", "grace"): ("person", 1.0, "onboarding", "Grace", False),
        ("Grace", None): ("person", 1.0, "onboarding", "Grace", False),
        ("harbour", "x"): ("project", 1.0, "onboarding", "Harbour", False),
        ("Zed", "x"): ("unknown", 0.0, "none", "Zed", False),
        ("max", "the max at noon"): ("concept", 0.8, "context_disambiguated", "max", True),
        (None, None): ("unknown", 0.0, "none", None, False),
    }


def test_unknown_and_learned(spark, registry):
    text = "Nora said yes.\nNora: hello\nNora asked, and she laughed. Thanks Nora\nhey Nora"
    df = spark.createDataFrame([(1, text), (2, "Nora Riley Monday Zoé Ünder Quite"), (3, "Riley said. Riley asked. Riley told. hey Riley"), (4, None)], "id long, document string")
    assert {tuple(r) for r in K.unknown_names(df, registry).collect()} == {(1, "Nora"), (1, "Thanks"), (2, "Nora"), (2, "Quite")}
    found = K.learned(df, registry).collect()
    assert [(r["name"], r["kind"], r["source"], r["ambiguous"]) for r in found] == [("Nora", "person", "learned", False)] and found[0]["confidence"] >= 0.75
    assert K.learned(df, registry, stop=("nora",)).count() == 0
    assert {(r["id"], r["name"]) for r in K.people_in(df, registry.unionByName(K.learned(df, registry).select(*registry.columns))).collect()} == {(1, "Nora"), (2, "Nora"), (2, "Riley"), (3, "Riley")}


def test_votes_without_patterns_of_a_name(monkeypatch):
    """The votes are those of each pattern with the name put in; no pattern is made for a name."""
    import random
    import re

    rnd = random.Random(5)
    parts = ["anan", "an", "off", "with", "ann", "ananan", "'s", "s'", ":", "the", "is", "said", "of", "to", "drop", "dropped", "my", "son", "have", "you", "if", "not", "was", "thanks", "hey", "will", "more", "since", "é", "x.y", "picked", "up"]
    texts = ["", "ananan of it", "drop off off", "drop off an", "anan: so", "my son  an", *("".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "  ", "\n"]) for _ in range(rnd.randint(1, 12))) for _ in range(1500))]
    names = ("an", "anan", "off", "with", "said", "x.y", "will", "is", "é", "my son", " an")
    want = [tuple(sum(re.search(p.replace("@", re.escape(n)), t) is not None for p in kind) for kind in (K.FOR, K.AGAINST)) for t in texts for n in names]
    assert [K.votes(n, t) for t in texts for n in names] == want and len(set(want)) > 6
    monkeypatch.setattr(re, "compile", None)
    assert K.votes("anna", "anna said it, not anna") == (2, 1)
