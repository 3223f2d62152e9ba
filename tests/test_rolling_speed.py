import random
import time

from pyspark.sql import functions as F

from regdelta.operators import rolling as W


def test_a_full_window_takes_one_step_a_row(spark):
    """A frame of 100,000 rows that was read anew for every row took minutes."""
    n = 100_000
    frame = spark.range(n).select("id", F.lit("k").alias("scope"), F.timestamp_seconds(F.col("id")).alias("ts"))
    start = time.monotonic()
    got = W.rolling_count(frame, "scope", "ts", n, "n").where("n <> id + 1").count()
    assert got == 0 and time.monotonic() - start < 60


def test_rows_without_time_are_counted_together(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0, 59, 60, 61, -1])) for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, scope string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.n for r in W.rolling_count(frame, "scope", "ts", 60, "n").collect()}
    for i, k, t in rows:
        assert got[i] == sum(k2 == k and (t2 is None if t is None else t2 is not None and t - 60 < t2 <= t) for _, k2, t2 in rows)
