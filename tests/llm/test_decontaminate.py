import collections
import random
import re

from lorekeep.llm import decontaminate as D
from lorekeep.llm import registry, runtime


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def stretch(same):
    now = best = 0
    for s in same:
        now = max(0, now + (1 if s else -D.COST))
        best = max(best, now)
    return best


def hit(same):
    return any(all(same[p + k] for k, m in enumerate(mask) if m == "1") for mask in D.MASKS for p in range(len(same) - len(mask) + 1))


def brute(docs, items):
    """Pairs with a good enough stretch on any alignment that a mask, or a whole short item, hits. Alignments with fewer equal
    tokens than a mask has marks, or than a short item has, are hit by none."""
    items = [(i, tokens(t)) for i, t in items]
    places = {}
    for n, (_, b) in enumerate(items):
        for k, w in enumerate(b):
            places.setdefault(w, []).append((n, k))
    least = min(m.count("1") for m in D.MASKS)
    out = {}
    for d, dt in docs:
        a = tokens(dt)
        equal = collections.Counter((n, at - k) for at, w in enumerate(a) for n, k in places.get(w, ()))
        for (n, shift), count in equal.items():
            i, b = items[n]
            if count < min(least, len(b)):
                continue
            same = [a[k + shift] == b[k] for k in range(len(b)) if 0 <= k + shift < len(a)]
            if not (len(same) == len(b) and all(same) if len(b) < min(map(len, D.MASKS)) else hit(same)):
                continue
            if (best := stretch(same)) >= min(D.SCORE, len(b)):
                out[d, i] = max(out.get((d, i), 0), best)
    return out


def run(spark, docs, items):
    a = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, dh int, seed int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(a, b).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)
    return {(r["doc_id"], r["item_id"]): r["score"] for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 8, 12, 20, 30])))) for i in range(12)]
    docs = []
    for d in range(160):
        text = rng.choices(words, k=rng.randrange(0, 60))
        if d % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 5)):
                passage[rng.randrange(len(passage))] = rng.choice(words).upper()
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage if d % 4 == 1 else passage[rng.randrange(len(passage)) :]
        docs.append((d, ", ".join(text) + "."))
    want = brute(docs, items)
    assert run(spark, docs, items) == want and len(want) > 8


def test_edges(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from it"
    docs = [(1, None), (2, ""), (3, item.upper()), (4, "x " * 20_000 + item + " y" * 20_000), (5, (item + ". ") * 3), (None, item), (6, "the quick brown fox")]
    found = run(spark, docs, [(1, item), (2, None), (3, ""), (4, item)])
    assert set(found) == {(d, i) for d in (3, 4, 5) for i in (1, 4)} and set(found.values()) == {14}
    assert run(spark, docs, []) == {} and run(spark, [], [(1, item)]) == {}
    left = D.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r[0] or 0) for r in left.collect()) == [0, 1, 2, 6]


def test_whole_table(spark, sf_dir):
    """All documents, long ones too."""
    docs, items = ([tuple(r) for r in runtime.table(spark, sf_dir, t).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in registry.op5_spaced_seeds(spark, sf_dir).collect()}
    assert got == brute(docs, items) and max(len(t) for _, t in docs) > 5000


def test_recall_of_the_masks():
    """Passages of 13 to 40 tokens with 5 to 25 percent of them exchanged: of those whose best stretch reaches the score, the
    masks hit nearly all."""
    rng = random.Random(4)
    reached = found = 0
    for _ in range(40_000):
        n, share = rng.randrange(13, 41), rng.uniform(0.05, 0.25)
        same = [rng.random() >= share for _ in range(n)]
        if stretch(same) >= D.SCORE:
            reached += 1
            found += hit(same)
    assert reached > 15_000 and found / reached > 0.999
