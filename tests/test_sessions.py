import random

import pytest

from lorekeep.sources import sessions as S

HEADER = "=== agent v"


def whole(text):
    """A file split in one go."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    starts = [k for k, line in enumerate(lines) if HEADER in line and not any(a in x for x in lines[k : k + 6] for a in S.AGAIN)]
    if len(starts) < 2:
        return []
    parts = [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
    return [(k, p) for k, p in enumerate(parts) if len(p) >= 10]


@pytest.mark.parametrize("split", ["300b", "128m"])
def test_like_whole_files(spark, tmp_path, split):
    """Split into pieces smaller than sessions and than the look-ahead, and not split at all."""
    rng = random.Random(4)
    texts = {}
    for f in range(6):
        kinds = [HEADER + "1.0", "said before", "> what about the plan", "press Ctrl+E to see", "12 previous messages", "", "é 漢 line"]
        texts[f"f{f}.txt"] = "".join(rng.choices(kinds, weights=[2, 8, 3, 1 if f % 2 else 0.2, 0.3, 2, 6])[0] + "\n" for _ in range(rng.choice((0, 5, 150, 400))))
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        numbered = S.lines(spark, str(tmp_path))
        found = S.sessions(numbered, HEADER).collect()
        pieces = numbered.select("file", "split").distinct().count()
    finally:
        for key, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), was, strict=True):
            spark.conf.set(key, value)
    got = {}
    for r in sorted(found, key=lambda r: (r["file"], r["session"], r["place"])):
        part = got.setdefault((r["file"].rsplit("/", 1)[1], r["session"]), [])
        assert r["place"] == len(part)
        part.append(r["line"])
    want = {(name, k): part for name, text in texts.items() for k, part in whole(text)}
    assert got == want and len(want) > 5 and (pieces > 12) == (split == "300b")


def test_described(spark):
    first = ["=== agent v1", "⏺ 2:30 PM Wednesday, March 5, 2026", "> git status", "> short", "> Fix the  authentication, flow! please", "alice: hi", *["x"] * 120, "Bob"]
    second = ["=== agent v1", "> ls -la", *["y"] * 60, "⏺ 2:30 PM Wednesday, March 25, 2026"]
    rows = [("f", k, place, line) for k, part in enumerate((first, second)) for place, line in enumerate(part)]
    df = spark.createDataFrame(rows, "file string, session int, place long, line string").repartition(3)
    got = {r["session"]: tuple(r)[2:] for r in S.described(df, ["Bob", "Alice", "Al"]).collect()}
    assert got == {0: (127, "2026-03-05_230PM", "2026-03-05", ["Alice"], "Fix-the-authentication-flow-please"), 1: (63, None, None, [], "session")}
    assert S.described(df.limit(0), []).count() == 0
