"""Helpers that every corpus operator shares: tables, shared storage, batch sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.shipping import ship
from regdelta.storage import cut

__all__ = ["cut", "fold", "hash_edge", "heavy_keys", "labelled_ids", "least_count", "leave_out", "python_tasks", "table", "tidy"]

#: Most rows that are sent to the texts to tell which of them go, about 80 bytes each.
BROADCAST_GOING = 1 << 20

#: Bounds of one Arrow batch. Texts can be long, so it is the bytes that count.
BATCH_ROWS = 10_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_tasks(spark: SparkSession) -> None:
    """Makes the session ready for Python tasks: they find this package, and a bound is set on what they hold at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, with the memory that it has freed handed back at the end: workers wait for the next stage beside those of others."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return tidied


def fold(doc_id: Column, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def heavy_keys(counts: DataFrame, key: str, total: int, share: int = 4096) -> DataFrame:
    """Keys that hold at least a share-th of all rows: at most `share` of them, however large the input."""
    return counts.where(F.col("n") >= max(2, -(-total // share))).select(key)


def least_count(counted: DataFrame, most: int) -> int:
    """The least n at which no more than `most` rows of counted have n or more; above all n if there is no such n."""
    # each n has a row, so no more than most + 1 of them can matter
    by_count = counted.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(most + 1).toPandas()
    if by_count.empty:
        return 1
    fit = by_count["n"][by_count["rows"].cumsum() <= most]
    return int(fit.iloc[-1]) if len(fit) else int(by_count["n"].iloc[0]) + 1


def leave_out(docs: DataFrame, going: DataFrame, ties: DataFrame, same) -> DataFrame:
    """docs without the rows that `going` names, and one row of those that a row of `ties` names.

    same: the condition that a row of docs is one that a row of going or ties names. Both are
    written and counted: up to BROADCAST_GOING rows of them go to the texts, which then stay where
    they are; more are joined as Spark sees fit. Rows that tie are aggregated before they move.
    """
    going, ties = cut(going, "going"), cut(ties, "ties")
    sized = lambda x: F.broadcast(x) if x.count() <= BROADCAST_GOING else x
    left = docs.join(sized(going), same, "left_anti")
    if ties.isEmpty():
        return left
    ties = sized(ties)
    one = left.join(ties, same).groupBy(*ties.columns).agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return left.join(ties, same, "left_anti").unionByName(one.select("_row.*"))


def hash_edge(rows: int, most: int) -> int:
    """xxhash64 values up to this one are about `most` of so many rows: the same ones on every run."""
    return 2**63 - 1 if rows <= most else int(-(2**63) + most / rows * (2**64 - 1))


def labelled_ids(labels: DataFrame, label_col: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, label): about `most` ids at most, drawn by the hash of the id; ids that are labelled both ways are left out."""
    rows = labels.where(learn & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    agreed = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("_most"))
    agreed = agreed.where("label = _most").select("doc_id", F.col("label").cast("int").alias("label"))
    return agreed.where(F.xxhash64("doc_id") <= F.lit(hash_edge(agreed.count(), most)))
