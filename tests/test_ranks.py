import random

from pyspark.sql import functions as F

from regdelta.operators.ranks import numbered


def test_places_over_many_partitions_with_a_hot_key(spark):
    draw = random.Random(3)
    rows = [("hot" if i % 3 else draw.choice("abc"), draw.choice([None, 1, 2, 3]), i) for i in range(500)]
    table = spark.createDataFrame(rows, "k string, v long, id long").repartition(7)
    got = numbered(table, [F.col("k").desc(), F.col("v").asc_nulls_last(), F.col("id")], "at", ["id"]).collect()
    ranked = sorted(rows, key=lambda r: r[2])
    ranked.sort(key=lambda r: (r[1] is None, r[1] or 0))
    ranked.sort(key=lambda r: r[0], reverse=True)
    assert sorted((r["at"], r["id"]) for r in got) == [(i + 1, r[2]) for i, r in enumerate(ranked)]


def test_no_rows(spark):
    assert numbered(spark.createDataFrame([], "k string"), [F.col("k")]).collect() == []
