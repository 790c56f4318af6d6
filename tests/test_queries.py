"""Every registered query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from lorekeep.engine import views
from lorekeep.functions.where import where
from lorekeep.operators import facts, retrieval, sync, texts, topics
from lorekeep.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_where(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "n int, s string")
    ids = lambda c, **o: [r[0] for r in df.where(where(c, **o)).orderBy("n").collect()]
    assert ids({}) == [1, 2, 3] and ids({"s": None}) == [2]
    assert ids({"s": {"$ne": "a"}}) == [3] and ids({"s": {"$ne": "a"}}, null_safe=True) == [2, 3]
    assert ids({"s": {"$nin": ["a"]}}, null_safe=True) == [2, 3] and ids({"n": {"$in": []}}) == []
    assert ids({"$or": [{"n": 1}, {"n": {"$gt": 2}}], "s": {"$in": ["a", "c"]}}) == [1, 3]
    with pytest.raises(ValueError):
        where({"n": {"$like": 1}})


def test_validity_bounds(spark):
    rows = [(1, "A", "works_on", "X", "2025-01-01", "2025-12-31"), (2, "A", "works_on", "Y", "2026-01-01", None), (3, "A", "is", "A", None, None)]
    df = spark.createDataFrame(rows, "fact_id long, subject string, predicate string, object string, valid_from string, valid_to string")
    at = lambda day: sorted(r[0] for r in df.where(facts.valid_at(day)).collect())
    assert at("2025-01-01") == at("2025-12-31") == [1, 3] and at("2026-06-15") == [2, 3]
    assert sorted((r["fact_id"], r["direction"]) for r in facts.both_ways(df, "a").collect()) == [(1, "outgoing"), (2, "outgoing"), (3, "incoming"), (3, "outgoing")]


def test_merge_ties(spark):
    schema = "id long, node_id string, updated_at long"
    local = spark.createDataFrame([(1, "b", 5), (2, "a", 5), (3, "a", 9), (4, "a", 5)], schema)
    remote = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "z", 8), (5, "a", 1), (4, "a", 5)], schema)
    assert {r["id"]: (r["outcome"], r["node_id"]) for r in sync.merge(local, remote).collect()} == {1: ("kept", "b"), 2: ("updated", "b"), 3: ("kept", "a"), 4: ("kept", "a"), 5: ("new", "a")}


def test_edges_of_texts_and_topics(spark):
    df = spark.createDataFrame([("a", "x" * 30), ("b", "y" * 1601), ("c", None)], "id string, document string")
    assert sorted((r["id"], r["slice_index"], len(r["content"])) for r in texts.bounded_slices(df).collect()) == [("b", 0, 800), ("b", 1, 800), ("b", 2, 1)]
    nodes = spark.createDataFrame([("t1", ["a", "b"], 2), ("t2", ["b", "c"], 1), ("t3", ["c"], 1), ("t4", ["d"], 1)], "topic string, domains array<string>, n long")
    assert [(r["topic"], r["hop"]) for r in topics.traverse(nodes, "t1").collect()] == [("t1", 0), ("t2", 1), ("t3", 2)]
    assert topics.traverse(nodes, "none").count() == 0


def test_dense_blocks(spark, sf_dir):
    """More queries than a block holds: none is broadcast with all others, and all have the answers of one block."""
    vectors = views.vectors(spark, sf_dir)
    queries = vectors.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    n = queries.count()
    assert n > 4 and len(retrieval._blocks(queries, 4)) == -(-n // 4) and len(retrieval._blocks(queries, n)) == 1
    rows = lambda **o: sorted(map(tuple, retrieval.dense_top_k(vectors, queries, 3, **o).collect()))
    assert rows(block=4) == rows() and len(rows(block=4)) == 3 * n


def test_words_of_each_query(spark):
    """Each query has its own words and weights; stop words and repeated words count once or not at all; blocks change nothing."""
    records = spark.createDataFrame([("a", "Token and password, the token"), ("b", "token only"), ("c", None), ("d", "nothing here"), ("e", "password token rest")], "id string, document string")
    words = spark.createDataFrame([(1, "token", 1.0), (1, "password", 0.5), (1, "token", 0.5), (1, "the", 1.0), (2, "rest", 1.0), (2, "absent", 1.0), (3, "the", 1.0), (4, "token", 0.0)], "query_id long, token string, weight double")
    want = [(1, "a", 1.0), (1, "b", 0.666667), (1, "e", 1.0), (2, "e", 0.5)]
    for block in (1, 10_000):
        assert sorted(map(tuple, retrieval.sparse_for_queries(records, words, 5, block).collect())) == want
    assert sorted(map(tuple, retrieval.sparse_for_queries(records, words, 1).collect())) == [(1, "a", 1.0), (2, "e", 0.5)]
