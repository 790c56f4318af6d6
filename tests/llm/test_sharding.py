import hashlib
import random
import zlib

from lorekeep.llm import registry, runtime, sharding


def brute(sizes, shards):
    """The smallest capacity by trying every one from the bottom up."""
    c = max([-(-sum(sizes) // shards), *sizes], default=0)
    while True:
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        if n <= shards:
            return c
        c += 1


def check(rows, texts, shards):
    groups = {}
    for doc, text in texts:
        body = (text or "").encode()
        groups.setdefault(hashlib.sha256(body).hexdigest(), []).append((doc, len(body) + 8, zlib.crc32(body)))
    sizes = [sum(x[1] for x in groups[k]) for k in sorted(groups)]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(x for g in groups.values() for x in g)
    by_shard, of = {}, {}
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by_shard.setdefault(r["shard"], []).append(r)
        of.setdefault(r["doc_id"], set()).add(r["shard"])
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    if sizes:
        assert max(sum(r["size"] for r in part) for part in by_shard.values()) == brute(sizes, shards)
    last = -1
    for k in sorted(groups):
        (here,) = {s for doc, _, _ in groups[k] for s in of[doc]}
        assert here >= last
        last = here


def run(spark, texts, shards=24):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return sharding.shard_rows(df, shards).collect()


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, "x" * rng.choice([1, 5, 40, 300]) + str(rng.randrange(400))) for i in range(700)]
    texts += [(1000 + i, "the same text") for i in range(300)]
    check(run(spark, texts), texts, 24)


def test_search_in_steps(spark):
    """So little may be loaded at once that prefixes are split again and again."""
    rng = random.Random(6)
    texts = [(i, f"{i} " + "y" * rng.randrange(200)) for i in range(3000)]
    groups = spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), len(t) + 8) for _, t in texts], "digest string, size long")
    sizes = [s for _, s in sorted((hashlib.sha256(t.encode()).hexdigest(), len(t) + 8) for _, t in texts)]
    assert sharding.minimax_cuts(groups, 7, load=1)[0] == brute(sizes, 7)
    first = sharding.FIRST
    try:
        sharding.FIRST = 1
        assert sharding.minimax_cuts(groups, 7, load=1)[0] == brute(sizes, 7)
        assert sharding.minimax_cuts(groups, 7, load=500)[0] == brute(sizes, 7)
    finally:
        sharding.FIRST = first


def test_edges(spark):
    for texts in ([], [(1, None), (2, ""), (3, None)], [(1, "a"), (1, "a"), (None, "b")], [(i, "t" * i) for i in range(5)]):
        rows = run(spark, texts)
        assert len(rows) == len(texts)
        if all(t[0] is not None for t in texts) and len({t[0] for t in texts}) == len(texts):
            check(rows, texts, 24)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 2, "z", 3)], "doc_id long, text string, size int, digest string, cell int")
    assert [r["size"] for r in sharding.shard_rows(df).collect()] == [9]


def test_whole_table(spark, sf_dir):
    texts = [(r[0], r[1]) for r in runtime.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check(registry.op6_minimax_shards(spark, sf_dir).collect(), texts, 24)


def test_cells_without_ids(spark):
    """Rows without an id, or that all have one, are spread over cells by their texts."""
    texts = [(None, f"text {k}") for k in range(4000)] + [(7, f"other {k}") for k in range(4000)]
    slots = {}
    for r in sharding.shard_rows(spark.createDataFrame(texts, "doc_id long, text string"), 3).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == len(texts)
