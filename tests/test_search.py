"""Search as one operator: modes, filters, context and explanations by example."""

import re

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import search as S

QUERIES = "query_id long, query string, embedding array<double>, context string, domain string, topic string, contributor string"


def at(distance):
    """A vector at this cosine distance from (1, 0)."""
    x = 1 - distance
    return [x, (1 - x * x) ** 0.5]


@pytest.fixture(scope="module")
def held(spark):
    texts = {
        "a": "general migration discussion with lots of context",
        "b": "auth migration from Auth0 to Clerk with rollback notes",
        "c": "billing migration plan",
        "d": None,
        "e": "auth clerk migration of another domain",
    }
    rows = [(i, t, "other" if i == "e" else "w", "r", "me", f"{i}.txt") for i, t in texts.items()]
    records = spark.createDataFrame(rows, "id string, document string, domain string, topic string, contributor string, source_file string").withColumn("token", F.lit("an extra column"))
    vectors = spark.createDataFrame([("a", at(0.10)), ("b", at(0.11)), ("c", at(0.12)), ("d", [0.0, 0.0]), ("e", at(0.5))], "id string, embedding array<double>")
    return records, vectors


def ask(spark, held, mode, limit=2, **given):
    row = {"query_id": 1, "query": "auth migration clerk", "embedding": [1.0, 0.0], **given}
    queries = spark.createDataFrame([tuple(row.get(c.split()[0]) for c in QUERIES.split(", "))], QUERIES)
    return sorted(S.search(*held, queries, mode, limit).collect(), key=lambda r: r["rank"])


def test_modes(spark, held):
    dense = ask(spark, held, "dense")
    assert [(r["id"], r["similarity"], r["lexical_score"], r["boosts"]) for r in dense] == [("a", 0.9, None, []), ("b", 0.89, None, [])]
    lexical = ask(spark, held, "lexical", domain="w")
    assert [(r["id"], r["lexical_score"], r["boosts"]) for r in lexical] == [("b", 1.0, ["lexical_rerank"]), ("a", 0.333333, ["lexical_rerank"])]
    hybrid = ask(spark, held, "hybrid", 5)
    assert [r["id"] for r in hybrid] == ["b", "e", "a", "c", "d"] and {r["matched_via"] for r in hybrid} == {"hybrid"}
    assert hybrid[-1]["boosts"] == ["hybrid_candidate_merge"] and hybrid[-1]["similarity"] == 0.0 and hybrid[0]["boosts"] == ["hybrid_candidate_merge", "lexical_rerank"]
    with pytest.raises(ValueError):
        S.search(*held, held[1], "nearest")


def test_words_find_what_vectors_miss(spark, held):
    records, vectors = held
    hybrid = ask(spark, (records, vectors.where("id <> 'b'")), "hybrid", 2, domain="w")
    assert [(r["id"], r["similarity"]) for r in hybrid] == [("b", None), ("a", 0.9)]
    assert [r["id"] for r in ask(spark, held, "hybrid", 2, embedding=None)] == ["b", "e"]


def test_context_and_filters(spark, held):
    assert [r["id"] for r in ask(spark, held, "lexical", 1, query="migration", context="billing plan")] == ["c"]
    assert ask(spark, held, "lexical", 1, query="migration", context="billing plan")[0]["lexical_score"] == 1.0
    assert [r["id"] for r in ask(spark, held, "dense", 9, domain="other")] == ["e"] and len(ask(spark, held, "dense", 9, domain="", topic="r", contributor="me")) == 5
    assert ask(spark, held, "hybrid", 9, topic="none") == []
    assert [r["lexical_score"] for r in ask(spark, held, "hybrid", 2, query=None)] == [None, None]
    long = "You are a helpful assistant. " * 20 + "Query: auth migration clerk"
    (best,) = ask(spark, held, "lexical", 1, query=long, domain="w")
    assert (best["id"], best["clean_query"], best["method"]) == ("b", "auth migration clerk", "labeled_tail")


def test_blocks_and_empty(spark, held):
    rows = [(k, w, at(k / 20), None, None, None, None) for k, w in enumerate(["auth", "plan billing", "notes", "context", None, "the"])]
    queries = spark.createDataFrame(rows, QUERIES)
    rows = lambda **o: sorted(map(repr, S.search(*held, queries, "hybrid", 3, **o).collect()))
    assert rows(block=2) == rows() and len(rows()) == 18
    assert S.search(held[0].limit(0), held[1].limit(0), queries).count() == 0 == S.search(*held, queries.limit(0)).count()


def test_nearest_without_direction(spark):
    """Zeros and nulls have no direction: they come last, after all others, and a block of two vectors is a task of its own."""
    from lorekeep.operators import retrieval as R

    rows = [(k, [1.0, float(k)], k % 2) for k in range(1, 7)] + [(7, [0.0, 0.0], 1), (8, None, 1), (9, [1.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = vectors.where("vec_id IN (1, 8)").selectExpr("vec_id AS query_id", "embedding AS query", "CASE WHEN vec_id = 8 THEN 0 END AS q_label")
    got = {q: [r["vec_id"] for r in sorted(R.dense_top_k(vectors, queries, 9).where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 8)}
    assert got == {1: [9, 2, 3, 4, 5, 6, 7, 8], 8: [1, 2, 3, 4, 5, 6, 7, 9]}
    held = R.nearest(vectors, queries, 9, keep=("label",), fits=("label",), zero=1.0, block=1, size=2)
    assert [r["vec_id"] for r in held.where("query_id = 8").orderBy("rank").collect()] == [2, 4, 6, 9]
    assert [r["distance"] for r in held.where("query_id = 1").orderBy("rank").collect()][-2:] == [1.0, 1.0]


def test_similarity_as_sql(spark):
    """Three places of a distance of six: SQL rounds the double times 1000, which is not the shortest decimal's half."""
    import duckdb

    from lorekeep.operators import retrieval as R

    steps = [*range(0, 1_000_000, 500), 1_000_300, 1_250_500, 2_000_000]
    rows = duckdb.execute("SELECT k, round(1 - k / 1000000.0::DOUBLE, 3) FROM (SELECT unnest(?::BIGINT[]) AS k) ORDER BY k", [steps]).fetchall()
    df = spark.createDataFrame([(k,) for k in steps], "k long").select("k", R.similarity(F.col("k") / 1e6).alias("s"))
    assert [tuple(map(repr, r)) for r in df.orderBy("k").collect()] == [tuple(map(repr, r)) for r in rows]
    assert dict(rows)[126_500] == 0.874


def test_words_in_parts(spark, monkeypatch):
    """However many blocks of records there are, what leaves them is a few times the best of each query; results are those over all pairs."""
    import random

    from lorekeep.operators import retrieval as R

    rng, counts, cells = random.Random(3), [], R.cells
    held = {f"r{n:03d}": {"all", *rng.sample("abcdefghij", 4)} for n in range(600)}
    asked = {q: {"all", *rng.sample("abcdefghij", 3)} for q in range(5)}
    many = lambda *a: counts.append((met := cells(*a)).count()) or met
    monkeypatch.setattr(R, "cells", many)
    words = spark.createDataFrame([(q, t, 1.0) for q, w in asked.items() for t in w], "query_id long, token string, weight double")
    want = {(q, i, round(s, 6)) for q, w in asked.items() for s, i in sorted(((len(w & h) / len(w), i) for i, h in held.items()), key=lambda x: (-x[0], x[1]))[:5]}
    for struct in (False, True):
        rows = spark.createDataFrame([(i, t) for i, h in held.items() for t in h], "id string, token string")
        rows = rows.withColumn("id", F.struct(F.substring("id", 1, 2).alias("a"), F.substring("id", 3, 9).cast("int").alias("b"))) if struct else rows
        found = R.best_by_words(rows, words, 5, size=10, count=600, first=2)
        name = F.concat("id.a", F.lpad(F.col("id.b").cast("string"), 2, "0")) if struct else F.col("id")
        assert {tuple(r) for r in found.select("query_id", name, "score").collect()} == want
    assert sum(counts) < 2 * 0.5 * 5 * 5 * 60


def test_near_pairs_make_no_row_for_each_word(spark, held):
    queries = spark.createDataFrame([(1, "migration context", at(0.1), None, None, None, None)], QUERIES)
    for mode in ("lexical", "hybrid"):
        plan = S.search(*held, queries, mode, 5)._jdf.queryExecution().executedPlan().toString()
        assert "Join [query_id" in plan and not re.search(r"Join \[query_id#\d+L?, token#", plan)
