"""Facts found in sentences of our own, and proposals on their way."""

import pytest

from lorekeep.operators import proposals as P

SCHEMA = "id string, document string, domain string, topic string, source_file string"

CASES = {
    "We switched from Redis to Kafka.": {("harbour", "migrated_from", "Redis", "asserted"), ("harbour", "migrated_to", "Kafka", "asserted")},
    "Last year they migrated from SVN to Git and never looked back.": {("harbour", "migrated_from", "SVN", "asserted"), ("harbour", "migrated_to", "Git", "asserted")},
    "Gateway uses Envoy now.": {("Gateway", "uses", "Envoy", "asserted")},
    "Billing depends on Ledger-2.": {("Billing", "depends_on", "Ledger-2", "asserted")},
    "The project deployed to Fly.": {("harbour", "deployed_to", "Fly", "asserted")},
    "Mina works on Beacon. Ola maintains Beacon!": {("Mina", "works_on", "Beacon", "asserted"), ("Ola", "maintains", "Beacon", "asserted")},
    "Maybe we could try Rust someday.": {("harbour", "uses", "Rust", "hypothetical")},
    "Gateway uses Nginx but we plan to leave.": {("Gateway", "uses", "Nginx", "planned")},
    "Does Gateway uses Envoy?": set(),
    "Nothing to see here.": set(),
    "": set(),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(str(k), text, "harbour", "room", "a.md") for k, text in enumerate(CASES)] + [("null", None, "harbour", "room", "a.md")]
    return P.extract(spark.createDataFrame(rows, SCHEMA))


def test_sentences(found):
    got = {k: set() for k in range(len(CASES))}
    for r in found.collect():
        got[int(r["id"])].add((r["subject"], r["predicate"], r["object"], r["modality"]))
    assert got == dict(enumerate(CASES.values()))


def test_repeats_and_sources(spark):
    """The last of equal facts counts; a text without a domain speaks for its file."""
    rows = [("a", "Gateway uses Envoy.\nGateway uses Envoy and will stay.", None, None, "b.md"), ("b", "We switched from Redis to Kafka.", "", None, "b.md"), ("c", "It use Redis.", None, None, None)]
    got = {(r["id"], r["subject"], r["object"]): (r["modality"], r["confidence"]) for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "Gateway", "Envoy"): ("planned", 0.58), ("b", "b.md", "Redis"): ("asserted", 0.9), ("b", "b.md", "Kafka"): ("asserted", 0.9), ("c", "project", "Redis"): ("asserted", 0.8)}
    assert P.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_way_of_a_proposal(spark, found):
    proposals = P.propose(found)
    n = proposals.count()
    once = P.reject(proposals, proposals["object"] == "Rust", "2025-02-01")
    again = P.merge(once, proposals)
    assert again.count() == n and [r["status"] for r in again.where("object = 'Rust'").collect()] == ["rejected"]

    facts = spark.createDataFrame([("gateway", "uses", "Caddy", "2024-01-01", None), ("Gateway", "uses", "Old", "2020-01-01", "2021-01-01")], "subject string, predicate string, object string, valid_from string, valid_to string")
    conflicts = {(r["subject"], r["object"]): r["conflicting"] for r in P.with_conflicts(again, facts).where("predicate = 'uses'").collect()}
    assert conflicts[("Gateway", "Envoy")] == ["Caddy"] and conflicts[("Gateway", "Nginx")] == [] and conflicts[("harbour", "Rust")] == []

    chosen = (again["object"] == "Envoy") | (again["object"] == "Rust")
    states, held = P.accept(again, facts, chosen, "2025-03-01", close_conflicts=True)
    assert {r["object"]: r["status"] for r in states.where("object IN ('Envoy', 'Rust', 'Kafka')").collect()} == {"Envoy": "accepted", "Rust": "rejected", "Kafka": "proposed"}
    assert {(r["object"], r["valid_from"], r["valid_to"]) for r in held.collect()} == {("Caddy", "2024-01-01", "2025-03-01"), ("Old", "2020-01-01", "2021-01-01"), ("Envoy", "2025-03-01", None)}


def test_facts_are_dealt_and_not_broadcast(spark, sf_dir):
    """Records of one file are many tasks' work, and proposals meet proposals without a broadcast."""
    from lorekeep.operators import proposals
    from lorekeep.plans.registry import queries

    found = queries()["kg_extract_rules"](spark, sf_dir)
    assert found.rdd.getNumPartitions() >= proposals.PARTS
    assert "Broadcast" not in queries()["kg_propose"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
