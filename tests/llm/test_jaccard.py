import random
import re

import numpy as np
import pytest

from lorekeep.llm import jaccard, registry, runtime
from lorekeep.llm.components import components

TABLE = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TABLE))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)))


def brute(docs):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for k, (d, s) in enumerate(sets):
        for near in {j for x in s for j in index.get(x, ())}:
            o = sets[near][1]
            both = len(s & o)
            if 100 * both >= 90 * (len(s) + len(o) - both):
                a, b = find(d), find(sets[near][0])
                up[max(a, b)] = min(a, b)
        for x in s:
            index.setdefault(x, []).append(k)
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs, common = [], " ".join(rng.choices(vocabulary, k=50))
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.6:
            words = rng.choice(docs[-40:])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            if rng.random() < 0.3:
                words = words[: len(words) - rng.randrange(3)]
            text = " ".join(words)
        elif kind < 0.75:
            text = common + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 9, 11, 14, 40, 90, 200])))
        docs.append((i * 3 + 1, text))
    rng.shuffle(docs)
    return docs


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in jaccard.jaccard_components(df, **options).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    assert run(spark, docs) == brute(docs)


def test_blocks(spark):
    """Blocks so small that groups fall into many: links across them must not get lost."""
    docs = corpus(7, 200)
    assert run(spark, docs, block_tokens=150) == brute(docs)


def test_tree_join_random():
    rng = random.Random(4)
    for _ in range(150):
        base = rng.sample(range(400), rng.randrange(9, 60))
        sets = []
        for _ in range(rng.randrange(2, 14)):
            s = set(base)
            for _ in range(rng.randrange(0, 6)):
                (s.discard if rng.random() < 0.5 else s.add)(rng.randrange(400))
            sets.append(np.array(sorted(s), np.uint64))
        sides = [rng.randrange(2) for _ in sets] if rng.random() < 0.4 else None
        union, up = jaccard.tree_join(sets, sides), jaccard.Union(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if (sides is None or sides[a] != sides[b]) and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    up.join(a, b)
        assert [union.find(k) for k in range(len(sets))] == [up.find(k) for k in range(len(sets))]


def test_keys_meet():
    """Sets that link always share a key."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.choice([9, 10, 12, 19, 25, 60, 150, 400]))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = a[rng.permutation(len(a))[: len(a) - int(rng.integers(0, len(a) // 9 + 1))]]
        b = np.unique(np.concatenate((b, rng.integers(0, 1 << 64, int(rng.integers(0, len(a) // 9 + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and min(len(a), len(b)) >= 9:
            assert set(jaccard.range_keys(a).tolist()) & set(jaccard.range_keys(b).tolist())


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {}
    for r in components(spark.createDataFrame(edges, "u long, v long")).collect():
        got.setdefault(r["label"], set()).add(r["id"])
    up = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    want = {}
    for v, c in up.items():
        want.setdefault(c, set()).add(v)
    assert sorted(sorted(s) for s in got.values()) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_edges(spark):
    docs = [(5, None), (6, ""), (7, "one"), (8, "ONE"), (9, "one two"), (10, "One\ttwo\n"), (11, "É x y"), (12, "é x y"), (3, " one ")]
    assert run(spark, docs) == [(3, 1, 3), (5, 0, 5), (6, 0, 6), (7, 1, 3), (8, 1, 3), (9, 1, 9), (10, 1, 9), (11, 1, 11), (12, 1, 12)]
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b c", 1, 2), (4, "a b c", 1, 2), (4, "a b c", 1, 2), (4, "x " * 30_000, 1, 2)], "doc_id long, text string, n int, comp int")
    rows = [tuple(r) for r in jaccard.jaccard_components(df).collect()]
    assert sorted(rows, key=str) == [(4, 1, 4), (4, 1, 4), (4, 1, 4), (None, 1, None)]


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in runtime.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in registry.op9_prefix_tree_join(spark, sf_dir).collect()) == brute(docs)


def brute_at(docs, size, percent):
    """doc_id -> component, with all pairs that share a shingle compared."""
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TABLE))
        sets.append((d, frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()))
    up, index = jaccard.Union(1 + max(d for d, _ in sets)), {}
    for k, (d, s) in enumerate(sets):
        for near in {j for x in s for j in index.get(x, ())}:
            both = len(s & sets[near][1])
            if 100 * both >= percent * (len(s) + len(sets[near][1]) - both):
                up.join(d, sets[near][0])
        for x in s:
            index.setdefault(x, []).append(k)
    return sorted((d, len(s), up.find(d)) for d, s in sets)


@pytest.mark.parametrize("block_tokens", [150, 1_000_000])
def test_five_words_at_80(spark, block_tokens):
    docs = corpus(11)
    got = run(spark, docs, size=5, percent=80, block_tokens=block_tokens)
    assert got == brute_at(docs, 5, 80) and [g[2] for g in got] != [g[2] for g in brute_at(docs, 3, 90)]


def test_keys_meet_at_80():
    rng = np.random.default_rng(6)
    linked = 0
    for _ in range(3000):
        n = int(rng.choice([4, 5, 6, 9, 12, 25, 60, 400, 3000]))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        lost = int(rng.integers(0, n // 5 + 1))
        b = np.concatenate((a[rng.permutation(n)[lost:]], rng.integers(0, 1 << 64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)))
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            linked += 1
            assert set(jaccard.range_keys(a, 80).tolist()) & set(jaccard.range_keys(b, 80).tolist())
    assert linked > 1000


@pytest.mark.parametrize(("size", "percent"), [(3, 60), (2, 85), (1, 50)])
def test_rare_shingles_as_keys(spark, size, percent):
    docs = corpus(12, 150)
    assert run(spark, docs, size=size, percent=percent) == brute_at(docs, size, percent)


def test_shared_passage_makes_no_large_group(spark, monkeypatch):
    """Documents that share a passage and nothing else aren't candidates: their number doesn't make groups grow."""
    rng = random.Random(13)
    passage = " ".join(f"p{i}" for i in range(150))
    docs = [(i, passage + " " + " ".join(f"d{i}x{k}" for k in range(rng.randrange(300, 400)))) for i in range(120)]
    docs += [(1000 + d, t + " end") for d, t in docs[:20]]
    sizes, across = [], jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda docs, large, *rest: (sizes.append(large.count()), across(docs, large, *rest))[1])
    assert run(spark, docs, size=5, percent=80, block_tokens=2_000) == brute_at(docs, 5, 80)
    assert not sizes


def test_first_shingles_meet():
    """Sets that link share one of their first counted shingles, however many documents have each."""
    rng = np.random.default_rng(7)
    linked = 0
    for _ in range(2000):
        percent, n = int(rng.choice([50, 65, 80, 89])), int(rng.choice([4, 5, 6, 9, 12, 25, 60, 400]))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.concatenate((a[rng.permutation(n)[int(rng.integers(0, n * (100 - percent) // 100 + 1)) :]], rng.integers(0, 1 << 64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)))
        b = np.unique(b)
        both = np.intersect1d(a, b)
        if 100 * len(both) < percent * (len(a) + len(b) - len(both)) or np.array_equal(a, b):
            continue
        linked += 1
        times = {int(x): 1 + int(rng.integers(1, 4)) if x in both else 1 + int(rng.integers(0, 3)) for x in np.union1d(a, b).view(np.int64)}
        cut = int(np.uint64(min((1 << 64) - 1, (2 * (100 - percent) << 64) // 100)))
        firsts = []
        for s in (a, b):
            keys = jaccard.counted(s, percent).view(np.uint64).tolist()
            keys.sort(key=lambda x: (x > cut, times[int(np.uint64(x).view(np.int64))] if x <= cut else 0, x))
            firsts.append(set(keys[: jaccard.first_of(len(s), percent)]))
        assert firsts[0] & firsts[1]
    assert linked > 500
