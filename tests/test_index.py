import numpy as np
import pytest

from lorekeep.operators import index

SCHEMA = "vec_id long, embedding array<double>, label int, distance string"


def rows_of(points, first=0):
    return [(first + i, None if p is None else [float(x) for x in p], i % 7, "x") for i, p in enumerate(points)]


def brute(rows, queries, k, skip_self=True):
    at = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows if r[1] is not None and 0 < np.linalg.norm(r[1]) < np.inf}
    out = set()
    for q in queries:
        if q in at:
            near = sorted((round(1 - float(at[q] @ v), 6) + 0.0, i) for i, v in at.items() if not (skip_self and i == q))
            out |= {(q, i, d, rank) for rank, (d, i) in enumerate(near[:k], 1)}
    return out


def asked(df, ids):
    return df.where(df["vec_id"].isin(ids)).selectExpr("vec_id AS query_id", "embedding AS query")


def got(found):
    return {(r["query_id"], r["vec_id"], r["distance"] + 0.0, r["rank"]) for r in found.collect()}


def clustered(seed, n, around=12, width=8, spread=0.05):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(around, width))[rng.integers(0, around, n)] + spread * rng.normal(size=(n, width))


@pytest.mark.parametrize(("block", "meeting", "k"), [(16, 3, 5), (8_192, 20_000, 5), (16, 20_000, 1), (50, 7, 700)])
def test_exact(spark, monkeypatch, block, meeting, k):
    """Clusters, one vector many times over, and lone ones, whatever the size of blocks and groups."""
    monkeypatch.setattr(index, "MEETING", meeting)
    points = [*clustered(1, 300), *[np.ones(8)] * 120, *np.random.default_rng(2).normal(size=(80, 8)), np.zeros(8), None, [float("inf")] * 8]
    rows = rows_of(points)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = index.build(df, block=block)
    ids = [r[0] for r in rows if r[0] % 20 == 0] + [301, 500, 501, 502]
    assert got(index.search(made, asked(df, ids), k)) == brute(rows, ids, k)
    assert made.rows.count() == 500 and made.blocks.groupBy().sum("n").first()[0] == 500


def test_extended_saved(spark, tmp_path):
    """Further vectors, also far from all centres, and an index written and read again."""
    old, new = rows_of(clustered(3, 200)), rows_of([*clustered(4, 150), *(9 * clustered(5, 50, around=3))], 200)
    df = spark.createDataFrame(old + new, SCHEMA)
    made = index.extend(index.build(df.where("vec_id < 200"), block=32), df.where("vec_id >= 200"), "1", block=32)
    index.save(made, str(tmp_path / "i"))
    ids = list(range(0, 400, 20))
    for one in (made, index.load(spark, str(tmp_path / "i"))):
        assert got(index.search(one, asked(df, ids), 6, skip_self=False)) == brute(old + new, ids, 6, skip_self=False)


def test_skips(spark):
    """Where vectors lie in clusters most blocks are not read; where they lie anywhere, answers are the same at a higher price."""
    df = spark.createDataFrame(rows_of(clustered(6, 3000, around=40, spread=0.02)), SCHEMA)
    made = index.build(df, block=64)
    assert index.share_read(made, asked(df, list(range(0, 3000, 100))), 5) < 0.2


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert index.search(index.build(df), df.selectExpr("vec_id AS query_id", "embedding AS query"), 3).count() == 0
    one = spark.createDataFrame(rows_of([[1.0, 0.0]]), SCHEMA)
    assert got(index.search(index.build(one), one.selectExpr("vec_id AS query_id", "embedding AS query"), 3)) == set()
