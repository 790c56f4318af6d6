import random

import pytest

from lorekeep.operators.batching import batched


def loop(rows, size, most):
    out, batch, count, held = {}, 0, 0, 0
    for key, chars in sorted(rows):
        out[key] = batch
        count, held = count + 1, held + (chars or 0)
        if count >= size or (most and held >= most):
            batch, count, held = batch + 1, 0, 0
    return out


@pytest.mark.parametrize(("size", "most", "rows_of_range"), [(7, 100, 13), (7, 0, 40), (1, 50, 30), (1000, 90, 25), (50, 400, 3), (7, 100, 500_000)])
def test_like_the_loop(spark, size, most, rows_of_range):
    """Whatever the ranges, also some shorter than a batch: the batches of the loop."""
    rng = random.Random(size + most)
    rows = [(k, rng.choice((0, 1, 5, 20, 90, 300, None))) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, chars long").repartition(3)
    got = batched(df, "id", size=size, most=most, rows_of_range=rows_of_range).collect()
    assert {r["id"]: r["batch"] for r in got} == loop(rows, size, most) and len(got) == len(rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, 5, 9)], "id long, chars long, batch_ int")
    assert [tuple(r) for r in batched(df, "id", size=3).collect()] == [(1, 5, 9, 0)]
    assert batched(df.limit(0), "id", size=3).count() == 0
    with pytest.raises(ValueError):
        batched(df, "id", size=0)
