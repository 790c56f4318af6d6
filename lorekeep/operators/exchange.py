"""Replicas of a table that meet: each sends what the other hasn't seen, in pages, until they agree.

Two versioned tables of (id, node_id, seq, updated_at, ...) exchange their changes in one session: the vectors of both (the
greatest sequence number seen of each node) are read once and hold for all its pages; the first sends, the second keeps the later
of two rows with one id and hands back the winners that beat what it was sent; then the other way round. A vector moves on only
when all pages of its direction were taken in, and is kept in the table's state, so knowledge of a row stays when a later one
replaced it. A session that breaks leaves tables that hold some pages; the next one sends them again, which changes nothing, as
the later row wins however often it comes.

The later row is the one with the greater (updated_at, node_id, seq), so every order of sessions ends with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.engine.shared import drop, store
from lorekeep.operators import sync
from lorekeep.sources.versions import VersionedTable

#: Changes that travel in one page.
PAGE = 100_000
#: Names in a table's state: its vector, and the node under which it writes.
VECTOR, NODE = "vector", "node"


@dataclass(frozen=True)
class Sent:
    """What one direction of a session moved: rows sent, rows that were new or later, and rows that lost to what was there."""

    sent: int
    accepted: int
    rejected: int


def vector_of(table: VersionedTable) -> dict[str, int]:
    """What a replica has seen of each node (one entry for each replica): its stored vector, and what it wrote itself since, if
    its state names its node. Rows say nothing else about it: a session that broke leaves rows whose predecessors are missing.
    A table that never met another has no vector yet; it has seen what its rows show."""
    state = table.state()
    rows = table.read() if VECTOR not in state else table.read().where(F.col("node_id") == state.get(NODE, ""))
    return merged(state.get(VECTOR, {}), {r["node_id"]: r["seq"] for r in sync.version_vector(rows).collect()})


def _keep(table: VersionedTable, vector: dict[str, int]) -> None:
    if table.state().get(VECTOR) != vector:
        table.set_state({**table.state(), VECTOR: vector}, "vector")


def merged(*vectors: dict[str, int]) -> dict[str, int]:
    return {node: max(v.get(node, 0) for v in vectors) for node in sorted({n for v in vectors for n in v})}


def changes_since(table: VersionedTable, vector: dict[str, int]) -> DataFrame:
    """The rows of a replica that a holder of ``vector`` hasn't seen; rows without a node or number are nobody's changes."""
    rows = table.read().where("node_id <> '' AND seq > 0")
    known = table.spark.createDataFrame(list(vector.items()), "node_id string, seq long")
    return sync.unseen(rows, known)


def count_since(table: VersionedTable, vector: dict[str, int]) -> int:
    return changes_since(table, vector).count()


def pages(changes: DataFrame, count: int, size: int) -> Iterable[DataFrame]:
    """A stored set of changes in pages of about ``size`` rows, dealt by their ids: no page needs a sort of all."""
    n = max(-(-count // size), 1)
    for k in range(n):
        yield changes if n == 1 else changes.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(n)) == k)


def later(a: str, b: str):
    """Whether the row ``a`` of a join is later than the row ``b``."""
    key = lambda x: F.struct(F.col(f"{x}.updated_at"), F.col(f"{x}.node_id"), F.col(f"{x}.seq"))
    return key(a) > key(b)


def take_in(table: VersionedTable, page: DataFrame) -> tuple[int, int, DataFrame]:
    """Puts the rows of a stored page that are new or later into ``table``. Returns how many those were, how many lost, and the
    rows that they lost to (a row that comes again meets itself: it isn't taken, and nothing beat it)."""
    held = store(table.read().join(page.select("id"), "id", "left_semi"), "exchange-held")
    met = page.alias("r").join(held.alias("l"), F.col("r.id") == F.col("l.id"), "left")
    wins = store(met.where(F.col("l.id").isNull() | later("r", "l")).select("r.*"), "exchange-wins")
    beaten = store(met.where(later("l", "r")).select("l.*"), "exchange-beaten")
    accepted = wins.count()
    if accepted:
        table.change(lambda base: base.join(wins.select("id"), "id", "left_anti").unionByName(wins, allowMissingColumns=True), wins, "exchange")
    return accepted, page.count() - accepted, beaten


def send(source: VersionedTable, target: VersionedTable, vector: dict[str, int], page: int, on_page: Callable[[int, int], None] | None) -> Sent:
    """One direction: everything in ``source`` that ``vector`` doesn't cover, page by page; the winners over it come back."""
    changes = store(changes_since(source, vector), "exchange-changes")
    total, moved, accepted, rejected = changes.count(), 0, 0, 0
    if total:
        for part in pages(changes, total, page):
            part = store(part, "exchange-page")
            won, lost, beaten = take_in(target, part)
            if not beaten.isEmpty():
                take_in(source, beaten)
            moved, accepted, rejected = moved + won + lost, accepted + won, rejected + lost
            drop(part)
            if on_page is not None:
                on_page(moved, total)
    drop(changes)
    return Sent(total, accepted, rejected)


def synchronise(local: VersionedTable, remote: VersionedTable, page: int = PAGE, on_page: Callable[[int, int], None] | None = None) -> tuple[Sent, Sent]:
    """One session: pushes from ``local``, then pulls from ``remote``; returns what each direction moved. ``on_page`` hears of each page."""
    mine, theirs = vector_of(local), vector_of(remote)
    _keep(local, mine)
    _keep(remote, theirs)
    pushed = send(local, remote, theirs, page, on_page)
    both = merged(mine, theirs)
    _keep(remote, both)
    pulled = send(remote, local, mine, page, on_page)
    _keep(local, both)
    return pushed, pulled


def converge(hub: VersionedTable, others: list[VersionedTable], page: int = PAGE) -> int:
    """Sessions of each of ``others`` with the hub until a round moves no row; returns the rounds. The first brings all
    changes to the hub, the second takes them to everyone, and the third finds nothing, unless something was written meanwhile."""
    rounds = 0
    while True:
        rounds += 1
        if not sum(s.accepted for table in others for s in synchronise(table, hub, page)):
            return rounds
