"""As-of joins against plain search, with one hot key over many ranges."""

import bisect
import random

import pytest

from quarry.operators.asof import asof_join


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_equals_search(spark, direction, tolerance):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None])
    left = [(key(), rng.choice([rng.randrange(400), None]) if i % 50 == 0 else rng.randrange(400), i) for i in range(1500)]
    right = sorted({(k, t) for k, t in ((key(), rng.randrange(30, 370)) for _ in range(90)) if k})
    found = asof_join(
        spark.createDataFrame(left, "k string, t int, i int").repartition(8), spark.createDataFrame([(k, t, t * 10) for k, t in right], "k string, at int, v int"), ["k"], "t", "at", direction, tolerance
    ).collect()
    assert len(found) == len(left) and {(r.k, r.t, r.i) for r in found} == set(left)
    times = {k: [t for x, t in right if x == k] for k in ("hot", "b", "c")}
    for r in found:
        own, want = times.get(r.k, []), None
        if r.t is not None and own:
            before = [own[bisect.bisect_right(own, r.t) - 1]] if own[0] <= r.t else []
            after = [own[bisect.bisect_left(own, r.t)]] if own[-1] >= r.t else []
            options = {"backward": before, "forward": after, "nearest": before + after}[direction]
            want = min(options, key=lambda t: abs(t - r.t), default=None)
            want = want if want is not None and (tolerance is None or abs(want - r.t) <= tolerance) else None
        assert (r.at, r.v) == ((want, want * 10) if want is not None else (None, None)), r


def test_asof_of_empty_tables(spark):
    left, right = spark.createDataFrame([(1, 5)], "k int, t int"), spark.createDataFrame([], "k int, at int, v int")
    assert [tuple(r) for r in asof_join(left, right, ["k"], "t", "at").collect()] == [(1, 5, None, None)]
    assert asof_join(left.limit(0), right, ["k"], "t", "at").count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_edges_between_rows_of_one_time(spark, direction):
    """Ranges end anywhere, so also between right and left rows of one key and time, or between such right rows."""
    rng = random.Random(2)
    left = [(k, t, i) for i, (k, t) in enumerate((k, t) for k in range(12) for t in (10, 20, 30) for _ in range(3))]
    right = [(k, t, rng.randrange(10**6)) for k in range(12) for t in (10, 20, 25) for _ in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        many = asof_join(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, at int, v int"), ["k"], "t", "at", direction).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = asof_join(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, at int, v int"), ["k"], "t", "at", direction).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {10: 10, 20: 20, 30: {"backward": 25, "forward": None, "nearest": 25}[direction]}
    assert len(many) == len(left) and all(r.at == want[r.t] for r in many)
    assert {tuple(r) for r in many} == {tuple(r) for r in one}
