import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lorekeep.llm import louds, registry, sql

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int"


def brute(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) by dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if conv is not None:
            own[conv].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - int(np.fmod(c, 5)), ())[:h]) + tuple(own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids[node])
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [(members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(kids[n]), leaves[n], saved[n], sha(ends[n])) for n in members]


def same(got, want):
    assert sorted(map(repr, map(tuple, got.select(*louds.FIGURES).collect()))) == sorted(map(repr, want))


def random_rows(seed, convs, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 4 * convs), convs):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choice(("user", "assistant")) if rng.random() < 0.2 else ("user", "assistant")[turn % 2], rng.choice(("a", "a", "a", "bé", "")), 0))
    return rows


@pytest.mark.parametrize("shard", [1, 9, 60, 250_000])
def test_random(spark, shard):
    """However the sequences are cut into ranges, the nodes are the same."""
    rows = random_rows(shard, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(louds.prefix_trie(df, shard), brute(rows))


def test_edges(spark):
    rows = [(None, 1, "user", "lost", 0), (3, None, "user", "first", 0), (3, 2, None, None, 0), (3, 2, None, None, 0), (3, 2, "assistant", "tie", 0), (3, 2, "assistant", "a tie", 0)]
    rows += [(10, k, "user", f"{k}", 0) for k in range(900)] + [(11, k, "user", f"{k}", 0) for k in range(900)] + [(12, 0, "user", "z" * 300_000, 0)]
    rows += [(c, 0, "system", "the same", 0) for c in range(1000, 1400)] + [(-7, 0, "user", "x", 0), (-6, 0, "user", "x", 0), (9, 5, "user", "no base", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    for shard in (500, 250_000):
        same(louds.prefix_trie(df, shard), want)
    assert louds.prefix_trie(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(8, 1, "user", "x", 0)], SCHEMA)  # no first of its five, and the text may be dropped
    same(louds.prefix_trie(lone), brute([(8, 1, "user", "x", 0)]))


def test_many_equal(spark, monkeypatch):
    """A sequence shared by many: its ids are joined in several chunks, in order."""
    monkeypatch.setattr(louds, "CHUNK", 7)
    rows = [(c, 0, "user", "hi", 0) for c in range(0, 2000)]
    same(louds.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)), brute(rows))


def test_bitvector():
    """The trie as such: parents and degrees read back from the bits, labels and levels against a plain one."""
    rng = random.Random(4)
    label = lambda k: hashlib.md5(bytes([k])).digest()
    for _ in range(200):
        seqs = sorted({b"".join(label(rng.randrange(3)) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 12))})
        trie, ends = louds.build(seqs, [np.arange(len(s) // 16) for s in seqs])
        nodes = sorted({s[: 16 * d] for s in seqs for d in range(len(s) // 16 + 1)}, key=lambda s: (len(s), s))
        assert len(trie) == len(nodes) and [nodes[e] for e in ends] == seqs
        assert trie.parents().tolist() == [-1] + [nodes.index(n[:-16]) for n in nodes[1:]]
        assert trie.degrees().tolist() == [sum(len(m) == len(n) + 16 and m.startswith(n) for m in nodes) for n in nodes]
        assert b"".join(trie.labels.astype(">u8").tobytes()[16 * k : 16 * k + 16] for k in range(len(nodes) - 1)) == b"".join(n[-16:] for n in nodes[1:])
        assert len(trie.louds) == -(-(2 * len(nodes) - 1) // 8)


def test_stored_tries(spark):
    rows = random_rows(1, 80)
    parts = louds.shards(louds.sequences(spark.createDataFrame(rows, SCHEMA)), 40)
    seen = 0
    for r in louds.tries(parts).collect():
        levels = np.frombuffer(r["levels"], np.int64)
        trie = louds.Trie(np.frombuffer(r["louds"], np.uint8), np.frombuffer(r["labels"], ">u8").reshape(-1, 2), np.frombuffer(r["sizes"], np.int64), levels)
        assert len(trie) == len(trie.labels) + 1 == len(trie.parents()) == len(trie.sizes)
        seen += 1
    assert seen > 2


def test_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(sql.OP12)
    assert list(want.columns) == list(louds.FIGURES)
    rows = [(*r, 0) for r in con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()]
    assert sorted(map(repr, want.fetchall())) == sorted(map(repr, brute(rows)))
    same(registry.op12_louds_prefix_trie(spark, sf_dir), brute(rows))
