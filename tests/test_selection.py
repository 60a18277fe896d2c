"""Exact order statistics of large groups against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import selection


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    return {
        "spread": [rng.random() * 1e6 for _ in range(3000)], "skewed": [10 ** rng.uniform(-200, 200) for _ in range(2500)], "few": [float(rng.randrange(3)) for _ in range(2000)], "one": [7.0] * 1500, "tiny": [3.0, 1.0, 2.0],
        "mixed": [-1e300, 1e300, float("inf"), float("-inf")] + [rng.gauss(0, 1) for _ in range(900)] + [0.5] * 700, "nan": [float("nan"), 1.0, 2.0], None: [float(i) for i in range(501)],
    }


def test_percentiles(spark, values):
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("spread", None), ("empty", None)]
    df = spark.createDataFrame(rows, "host string, latency double").repartition(7)
    ps = (0.0, 1.0, 50.0, 95.0, 100.0)
    want = {}
    for k, vs in values.items():
        ordered = sorted(vs, key=lambda v: (v != v, v))
        want[k] = [str(ordered[round(p / 100 * (len(vs) - 1))]) for p in ps]
    for small in (50, 100_000):
        got = {r.host: [str(r[f"p{int(p)}"]) for p in ps] for r in selection.percentiles(df, "host", "latency", ps, small).collect()}
        assert got == want
    assert selection.percentiles(df.limit(0), "host", "latency").count() == 0


def test_at_places_without_a_task_that_holds_a_group(spark):
    rows = spark.range(200_000).select(F.lit("hot").alias("key"), (F.col("id") * 7919 % 200_003).alias("value"))
    places = spark.createDataFrame([("hot", p) for p in (0, 1, 99_999, 150_000, 199_999, 200_000, -1)] + [("none", 0)], "key string, place long")
    ordered = sorted(i * 7919 % 200_003 for i in range(200_000))
    got = {r.place: r.value for r in selection.at_places(rows, places, 500).collect()}
    assert got == {p: ordered[p] for p in (0, 1, 99_999, 150_000, 199_999)}


@pytest.mark.parametrize("cap", [0, 1, 60, 137, 399, 400, 450, 1000])
def test_newest(spark, cap):
    rng = random.Random(cap)
    rows = [(i, float(rng.choice([1, 2, 2, 2, 3, 50, 51])) if i % 11 else None) for i in range(440)]
    df = spark.createDataFrame(rows, "id long, ts double")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), -r[0]))[:cap]
    for small in (20, 100_000):
        assert sorted(map(tuple, selection.newest(df, "ts", "id", cap, small).collect()), key=str) == sorted(want, key=str)
