"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdelta.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, label: str) -> DataFrame:
    """(a, b): each vertex a of an edge that is not the least of its component, with that least b.

    edges: columns a and b, of one ordered type, without self-loops. Only two figures a
    round reach the driver. Every round's table lies in the shared folder. A hub's edges
    are aggregated before they are shuffled, and its side of the join can be split.
    """
    now = cut(_small_star(edges.where("a != b").distinct()), label)
    seen = _digest(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)), label)
        got = _digest(now)
        if got == seen:
            break
        seen = got
    return now
