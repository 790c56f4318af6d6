import random

import pytest

from lorekeep.operators import exchange
from lorekeep.sources.versions import VersionedTable

SCHEMA = "id string, node_id string, seq long, updated_at long, document string"


def replicas(spark, tmp_path, seed, names=("hub", "a", "b")):
    """Replicas that share some history and wrote on, each under its own node."""
    rng = random.Random(seed)
    shared = [(f"r{k}", "old", k + 1, rng.randrange(50), f"old {k}") for k in range(30)]
    tables = {}
    for name in names:
        rows = {r[0]: r for r in shared}
        for seq in range(1, 41):
            row = (f"r{rng.randrange(60)}", name, seq, rng.randrange(100), f"{name} {seq}")
            if row[0] not in rows or row[3:0:-1] > rows[row[0]][3:0:-1]:
                rows[row[0]] = row
        tables[name] = VersionedTable(spark, str(tmp_path / name), buckets=4)
        tables[name].write(spark.createDataFrame(sorted(rows.values()), SCHEMA), 0, state={"node": name})
    return tables


def rows(table):
    return sorted(map(tuple, table.read().select("id", "node_id", "seq", "updated_at", "document").collect()))


def full_merge(tables):
    best = {}
    for r in (r for t in tables for r in rows(t)):
        if r[0] not in best or (r[3], r[1], r[2]) > (best[r[0]][3], best[r[0]][1], best[r[0]][2]):
            best[r[0]] = r
    return sorted(best.values())


@pytest.mark.parametrize("page", [7, 100_000])
def test_one_session(spark, tmp_path, page):
    t = replicas(spark, tmp_path, page, ("hub", "a"))
    want = full_merge(t.values())
    heard = []
    pushed, pulled = exchange.synchronise(t["a"], t["hub"], page, lambda done, total: heard.append((done, total)))
    assert rows(t["a"]) == rows(t["hub"]) == want
    assert pushed.sent == pushed.accepted + pushed.rejected > 0 and pulled.sent > 0
    assert heard[-1][0] == heard[-1][1] and (len(heard) > 4) == (page == 7)
    assert exchange.vector_of(t["a"]) == exchange.vector_of(t["hub"])
    assert exchange.count_since(t["a"], exchange.vector_of(t["hub"])) == 0
    version = t["hub"].versions()
    assert exchange.synchronise(t["a"], t["hub"]) == (exchange.Sent(0, 0, 0), exchange.Sent(0, 0, 0)) and t["hub"].versions() == version


class Broken(Exception):
    pass


def test_any_interruption(spark, tmp_path):
    """Broken after each number of pages in turn, then done again: the same end as without a break."""
    for at in (1, 6):
        t = replicas(spark, tmp_path / str(at), 5, ("hub", "a"))
        want, left = full_merge(t.values()), [at]

        def stop(done, total, left=left):
            left[0] -= 1
            if left[0] == 0:
                raise Broken

        with pytest.raises(Broken):
            exchange.synchronise(t["a"], t["hub"], 6, stop)
        row = ("r1", "a", 41, 1000, "written after the break")
        t["a"].upsert(spark.createDataFrame([row], SCHEMA), "seq")
        want = sorted([r for r in want if r[0] != "r1"] + [row])
        exchange.synchronise(t["a"], t["hub"], 9)
        assert rows(t["a"]) == rows(t["hub"]) == want


def test_hub_and_others(spark, tmp_path):
    t = replicas(spark, tmp_path, 3)
    want = full_merge(t.values())
    assert exchange.converge(t["hub"], [t["a"], t["b"]]) == 3
    assert rows(t["hub"]) == rows(t["a"]) == rows(t["b"]) == want


def test_edges(spark, tmp_path):
    """Rows of no node don't travel; an empty replica gets all; ties of time and node go by number."""
    a, hub = (VersionedTable(spark, str(tmp_path / n), buckets=2) for n in ("a", "hub"))
    a.write(spark.createDataFrame([("1", "", 4, 1, "nobody's"), ("2", "a", None, 1, "no number"), ("3", "a", 1, 5, "first"), ("4", None, 2, 1, None)], SCHEMA), 0, state={"node": "a"})
    hub.write(spark.createDataFrame([], SCHEMA), 0)
    exchange.synchronise(a, hub)
    assert [r[0] for r in rows(hub)] == ["3"] and len(rows(a)) == 4
    a.upsert(spark.createDataFrame([("3", "a", 2, 5, "second")], SCHEMA), "seq")
    exchange.synchronise(a, hub)
    assert [r[4] for r in rows(hub)] == ["second"]
