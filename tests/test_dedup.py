import random
import re

import pytest

from lorekeep.operators import dedup


def loop(rows, threshold=0.15, least=5):
    """The sequential loop over each source."""
    by_source = {}
    for id_, source, text in rows:
        by_source.setdefault(source or "", []).append((id_, source, text))
    out = set()
    for group in by_source.values():
        kept = []
        for id_, source, text in sorted(group, key=lambda r: (-len(r[2] or ""), r[0])):
            words = {w.lower() for w in re.findall(r"\w{2,}", text or "")}
            if len(group) < least:
                decision = "unchecked"
            elif len(text or "") < 20:
                decision = "short"
            elif any(words and k and round(1 - len(words & k) / len(words | k), 6) < threshold for k in kept):
                decision = "duplicate"
            else:
                decision = "kept"
                kept.append(words)
            out.add((id_, source, decision))
    return out


def texts(seed, count):
    """Texts that differ from earlier ones of their source by few words, in chains, with copies and short ones."""
    rng = random.Random(seed)
    rows, made = [], {}
    for k in range(count):
        source = rng.choice(("a.txt", "a.txt", "a.txt", "b.txt", None, "rare.txt" if rng.random() < 0.02 else "b.txt"))
        old = made.setdefault(source, [])
        words = list(rng.choice(old)) if old and rng.random() < 0.8 else [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
        if rng.random() < 0.3:
            words.append(f"w{rng.randrange(60)}")
        old.append(words)
        rows.append((f"id{k:05d}", source, " ".join(words)))
    return rows


@pytest.mark.parametrize(("pairs", "rounds"), [(64, 25), (0, 25), (0, 2), (0, 0)])
def test_like_the_loop(spark, monkeypatch, pairs, rounds):
    """By leaders, by pairs, or one after the other: the same decisions as record by record."""
    monkeypatch.setattr(dedup.removed, "__defaults__", (pairs, rounds))
    rows = texts(7 + rounds, 500)
    got = dedup.near_duplicates(spark.createDataFrame(rows, "id string, source_file string, document string").repartition(3))
    want = loop(rows)
    assert {r[2] for r in want} >= {"kept", "duplicate", "short"}
    assert set(map(tuple, got.collect())) == want and got.count() == len(rows)


def test_edges(spark):
    schema = "id string, source_file string, document string, words int"
    chain = [f"{' '.join(f'w{i}' for i in range(k, k + 40))}" for k in range(0, 60, 3)]  # each near its neighbours only
    rows = [(f"c{k:02d}", "chain", t, 0) for k, t in enumerate(chain)]
    rows += [("n1", None, None, 0), ("n2", None, "", 0), ("n3", None, "!" * 30, 0), ("n4", None, "!" * 30, 0), ("n5", None, "漢字 漢字 " * 9, 0), ("n6", None, "漢字 " * 18, 0)]
    rows += [(f"f{k}", "few", "the very same text of a record", 0) for k in range(4)] + [(f"m{k}", "many", "the very same text of a record", 0) for k in range(300)]
    rows += [(f"o{k}", "other", "the very same text of a record", 0) for k in range(5)] + [("big", "many", "word " * 200_000, 0)]
    got = {r[0]: r[2] for r in dedup.near_duplicates(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert got == {r[0]: r[2] for r in loop([r[:3] for r in rows])}
    assert sum(got[f"m{k}"] == "kept" for k in range(300)) == sum(got[f"o{k}"] == "kept" for k in range(5)) == 1
    assert 2 < sum(got[f"c{k:02d}"] == "kept" for k in range(20)) < 20 and got["n3"] == got["n4"] == "kept"
    empty = dedup.near_duplicates(spark.createDataFrame([], schema))
    assert empty.count() == 0 and dedup.outcome(empty).count() == 0


def test_scope(spark):
    df = spark.createDataFrame([("1", "src/Auth.py", "x", "d1"), ("2", "src/auth.py", "x", "d2"), ("3", None, "x", "d1")], "id string, source_file string, document string, domain string")
    ids = lambda **o: sorted(r[0] for r in dedup.in_scope(df, **o).collect())
    assert ids() == ["1", "2", "3"] and ids(source="AUTH") == ["1", "2"] and ids(source="auth", domain="d1") == ["1"]


@pytest.mark.parametrize("threshold", [0.05, 0.15, 0.3, 0.5])
def test_keys_of_ranges(spark, threshold):
    """Near sets of any size share a key, the nearest to the threshold too; sets that share half of their words meet seldom."""
    rng = random.Random(int(threshold * 100))
    word = lambda: rng.randrange(-(2**63), 2**63)
    sets = [set()]
    for size in [*range(1, 60), 100, 333, 1000]:
        first = [word() for _ in range(size)]
        sets.append(set(first))
        for drop in range(0, size, max(1, size // 12)):
            for new in {0, drop // 2, drop}:
                sets.append({*first[drop:], *(word() for _ in range(new))})
    rows = [(f"{k:05d}", "s", sorted(s)) for k, s in enumerate(sets)]
    found = {}
    for key, id_ in map(tuple, dedup.keys(spark.createDataFrame(rows, "id string, source string, words array<long>"), threshold).collect()):
        found.setdefault(int(id_), set()).add(key)
    near = apart = met = 0
    for a in range(len(sets)):
        for b in range(a + 1, min(a + 60, len(sets))):
            if sets[a] == sets[b] or not sets[a] or not sets[b]:
                continue
            distance = round(1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)
            meet = bool(found.get(a, set()) & found.get(b, set()))
            assert meet or distance >= threshold
            near += distance < threshold
            far = len(sets[a]) > 30 and len(sets[b]) > 30 and distance > 0.6
            apart, met = apart + far, met + (far and meet)
    assert near > 50 and apart > 100
    assert threshold > 0.15 or met < 0.2 * apart


def test_shared_keys(spark):
    """Near sets share as many keys as either needs, and a passage alike is not enough to be compared."""
    rng = random.Random(4)
    word = lambda: rng.randrange(-(2**63), 2**63)
    sets = []
    for size in [*range(2, 40, 3), 80, 150, 400, 900]:
        for _ in range(6):
            first = [word() for _ in range(size)]
            gone = rng.randrange(1, max(2, size // 6))
            sets += [sorted(set(first)), sorted({*first[gone:], *(word() for _ in range(rng.choice((0, gone // 2))))})]
    df = spark.createDataFrame([(k, "s", w) for k, w in enumerate(sets)], "id long, source string, words array<long>")
    found, need = {}, {}
    for key, id_, least in map(tuple, dedup._keyed(df, 0.15).collect()):
        found.setdefault(id_, set()).add(key)
        need[id_] = least
    near = strict = 0
    for a in range(0, len(sets), 2):
        x, y = set(sets[a]), set(sets[a + 1])
        if x != y and round(1 - len(x & y) / len(x | y), 6) < 0.15:
            least = max(need[a], need[a + 1])
            near, strict = near + 1, strict + (least > 1)
            assert len(found[a] & found[a + 1]) >= least
    assert near > 20 and strict > 10


def test_pairs_are_compared_in_parts(spark, monkeypatch):
    """A chance key is no pair to compare, and words are shuffled for about as many pairs at a time as there are records."""
    stored, store = [], dedup.store
    monkeypatch.setattr(dedup, "store", lambda df, name: stored.append((name, store(df, name))) or stored[-1][1])
    base = spark.createDataFrame([(f"r{k}", "s", [*range(100), 1000 + k]) for k in range(8)], "id string, source string, words array<long>")
    pairs = [(f"r{a}", f"r{b}", 3) for a in range(8) for b in range(a)]
    shared = spark.createDataFrame(pairs * 3, "a string, b string, need int")
    got = sorted(map(tuple, dedup.near(shared, base, 0.15).collect()))
    assert got == sorted((a, b) for a, b, _ in pairs)
    parts = [df.count() for name, df in stored if name == "dedup-part"]
    assert len(parts) == 4 and sum(parts) == 28
    assert dedup.near(spark.createDataFrame(pairs * 2, "a string, b string, need int"), base, 0.15).count() == 0
