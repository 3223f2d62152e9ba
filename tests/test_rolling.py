import random

import pytest
from pyspark.sql import functions as F

from regdelta.operators import rolling as W
from regdelta.operators.ranks import running_total


@pytest.mark.parametrize("hot", [0, 40, 1 << 20])
def test_counts_are_the_same_for_hot_keys(spark, hot):
    rng = random.Random(hot)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *[rng.randrange(400) for _ in range(9)]])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, scope string, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(6)
    got = {r.id: r.n for r in W.rolling_count(frame, "scope", "ts", 60, "n", hot).collect()}
    assert len(got) == len(rows)
    for i, k, t in rows:
        if t is not None:
            assert got[i] == sum(k2 == k and t2 is not None and t - 60 < t2 <= t for _, k2, t2 in rows)


def test_running_totals_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50)) for i in range(300)]
    got = {r.i: r.t for r in running_total(spark.createDataFrame(rows, "i long, v long").repartition(5), [F.col("i")], "v", "t").collect()}
    total = 0
    for i, v in rows:
        total += v
        assert got[i] == total


def test_the_given_window_of_a_breaker(spark):
    """Ten failures within a minute trip, nine do not, and one that is a minute old is out."""
    calls = [("s", t, True) for t in (0, 1, 2, 3, 4, 5, 6, 7, 8, 59)] + [("q", t, True) for t in (0, 1, 2, 3, 4, 5, 6, 7, 8, 60)] + [("s", 30, False)]
    frame = spark.createDataFrame(calls, "scope string, t long, failed boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = [(r.scope, r.opened_at.timestamp(), r.open_until.timestamp(), r.trips) for r in W.breaker_intervals(frame).collect()]
    assert got == [("s", 59.0, 359.0, 1)]
