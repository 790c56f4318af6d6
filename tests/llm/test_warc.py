import hashlib
import random

from lorekeep.llm import registry, runtime, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, node int, hash int")


def run(spark, a, b):
    return {r["page_id"]: r for r in warc.audit(pages(spark, a), pages(spark, b)).collect()}


def size(url, html):
    return len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n{html}\r\n\r\n")


def test_locates_every_fault(spark):
    rng = random.Random(1)
    left = [(i, f"u{i}", "h" * rng.randrange(50), 0, 0) for i in sorted(rng.sample(range(200_000), 400))]
    right = list(left)
    right[10] = (left[10][0], left[10][1], left[10][2] + "x", 0, 0)
    right[200] = (left[200][0], "other", left[200][2], 0, 0)
    del right[300]
    right.append((900_000, "new", "", 0, 0))
    got = run(spark, left, right)
    assert {k: r["status"] for k, r in got.items()} == {left[10][0]: "corrupt", left[200][0]: "corrupt", left[300][0]: "missing", 900_000: "extra"}
    for k in (10, 200, 300):
        before = [r for r in left[:k] if r[0] // warc.FILE_KEYS == left[k][0] // warc.FILE_KEYS]
        assert got[left[k][0]]["record_offset"] == sum(size(r[1], r[2]) for r in before)
        assert got[left[k][0]]["length"] == size(left[k][1], left[k][2])
    assert got[900_000]["length"] is None


def test_descends_only_below_differences(spark):
    left = [(i, "u", str(i), 0, 0) for i in range(3000)]
    right = [(i, "u", str(i) + "!" * (i == 1234), 0, 0) for i in range(3000)]
    a, b = warc.trees(*(warc.records(pages(spark, x)) for x in (left, right)))
    assert [x.count() for x in a] == [x.count() for x in b] == [3000, 188, 12]
    assert warc.root(a) != warc.root(b)
    assert [r[0] for r in warc.differing_keys(a, b).collect()] == [1234]


def test_edges(spark):
    some = [(None, None, None, 0, 0), (1, "u", None, 0, 0), (1, "u", None, 0, 0), (2, "v", "x" * 300_000, 0, 0)]
    assert run(spark, some, some) == {}
    assert run(spark, [], []) == {}
    assert {k: r["status"] for k, r in run(spark, some, some[1:2] + some[3:]).items()} == {None: "missing", 1: "missing"}
    assert {k: r["status"] for k, r in run(spark, [], some).items()} == {None: "extra", 1: "extra", 2: "extra"}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    df = runtime.table(spark, sf, "pages")
    before, after = ({r[0]: tuple(r) for r in x.collect()} for x in (df, warc.damaged(df)))
    got = {r["page_id"]: r["status"] for r in registry.op1_merkle_fixity(spark, sf).collect()}
    assert set(got) == {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}


def test_shared_keys(spark):
    """Every differing record of a key is a row with its own offset, also equal copies; none is paired by guess."""
    left = [(None, "u", f"n{i}", 0, 0) for i in range(30)] + [(7, "u", "same", 0, 0)] * 5 + [(7, "u", "z", 0, 0), (8, "u", "old", 0, 0)]
    right = left[4:30] + [(None, "u", "new", 0, 0)] + left[33:36] + [(7, "u", "more", 0, 0)] * 2 + [(8, "u", "now", 0, 0)]
    got = [tuple(r) for r in warc.audit(pages(spark, left), pages(spark, right)).collect()]
    assert sorted((str(r[0]), r[1]) for r in got) == sorted([("None", "missing")] * 4 + [("None", "extra")] + [("7", "missing")] * 3 + [("7", "extra")] * 2 + [("8", "corrupt")])

    def record(r):
        body = r[2]
        text = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {r[1]}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
        return hashlib.sha256(text.encode()).hexdigest(), len(text)

    want, at = [], {}
    for k, r in sorted(((-1 if r[0] is None else r[0]), record(r)) for r in left):
        start = at.get(k // warc.FILE_KEYS, 0)
        at[k // warc.FILE_KEYS] = start + r[1]
        want.append((k, r[0], start, r[1]))
    lost = sorted(x for k, v in {(-1, f"n{i}"): 1 for i in range(4)}.items() for x in [w for w in want if w[:2] == (k[0], record((0, "u", k[1]))[0])][:v])
    lost += [w for w in want if w[:2] == (7, record((0, "u", "same"))[0])][:3] + [w for w in want if w[0] == 8]
    assert sorted((-1 if r[0] is None else r[0], r[5], r[3], r[4]) for r in got if r[1] != "extra") == sorted(lost)
    assert all(r[3] is None and r[4] is None and r[5] is None and r[6] for r in got if r[1] == "extra")


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 4)
    got = warc.audit(pages(spark, [(1, "u", "x", 0, 0)] * 13), pages(spark, [(1, "u", "x", 0, 0)] * 2)).collect()
    assert sorted(r["record_offset"] for r in got) == [k * size("u", "x") for k in range(11)]


def test_signs_and_nulls(spark):
    """Negative keys are keys like others, and a null key is none of them, -1 included."""
    left = [(k, "u", "x", 0, 0) for k in (None, -1, -5, 0, 5, -(1 << 62), (1 << 62))]
    right = [(k, "u", "x" if k in (0, 5) else "y", 0, 0) for k in (None, -1, -5, 0, 5, -(1 << 62), (1 << 62))]
    got = run(spark, left, right)
    assert {k: r["status"] for k, r in got.items()} == dict.fromkeys((None, -1, -5, -(1 << 62), 1 << 62), "corrupt")
    assert got[None]["file_id"] is None and got[None]["record_offset"] == 0 and got[-1]["record_offset"] == size("u", "x") and got[-5]["file_id"] == -1
    assert set(run(spark, left, left[1:])) == {None} and set(run(spark, left[:1], left[:2])) == {-1}
    large = [((1 << 62) + k, "u", "x", 0, 0) for k in range(40)]
    assert set(run(spark, large, large[:7] + large[8:])) == {large[7][0]}


def test_equal_roots_end_the_audit(spark):
    a, b = warc.trees(*(warc.records(pages(spark, [(i, "u", "x", 0, 0) for i in order])) for order in (range(500), reversed(range(500)))))
    assert warc.root(a) == warc.root(b) and warc.differing_keys(a, b).count() == 0


def test_hot_key_is_cut_into_cells(spark):
    left = [(3, "u", f"text {i}", 0, 0) for i in range(2000)] + [(2, "u", "before", 0, 0), (4, "u", "after", 0, 0)]
    got = run(spark, left, left[:2001])[4]
    assert got["status"] == "missing" and got["record_offset"] == sum(size(r[1], r[2]) for r in left[:2001])
