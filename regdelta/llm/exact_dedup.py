"""Exact duplicates by counting quotient filters.

Every partition of the input builds one counting quotient filter over the 64-bit
fingerprints of its texts: the high bits (the quotient) name a block, the low bits (the
remainder) stand sorted in the block's run, each with its counter. Filters merge block
by block: runs are concatenated, sorted by remainder, counters of equal remainders
added. A run is kept as a sorted array of whole remainders beside an array of counters: it is
the sorted, lossless form that filters are merged in, without packed slots and their run-end bits,
which serve lookups that no one makes here. Quotient and remainder together are the whole
fingerprint, so merging loses nothing. Fingerprints that were counted once are settled; those counted more often send
their texts to a byte comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, heavy_keys, leave_out, python_tasks, table

#: Fingerprints that one merged block holds on average; sets the number of quotient bits.
BLOCK_FINGERPRINTS = 1 << 16

FILTER_SCHEMA = "block int, remainders binary, counters binary"


def quotient_bits(rows: int) -> int:
    """Bits of the block number, so that a merged block has about BLOCK_FINGERPRINTS entries."""
    return max(4, min(24, int(np.ceil(np.log2(max(1, rows) / BLOCK_FINGERPRINTS + 1)))))


def runs(fingerprints: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with their added counters."""
    order = np.argsort(fingerprints, kind="stable")
    f, c = fingerprints[order], counters[order]
    if not len(f):
        return f, c
    first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    return f[first], np.add.reduceat(c, first)


def partition_filter(bits: int):
    """Builds the filter of one partition and emits it block by block.

    The filter holds distinct fingerprints alone, 16 bytes each; a partition that
    has very many of them hands its filter over in pieces, which merge like those of
    different partitions.
    """
    most = 1 << 21

    def emit(f: np.ndarray, c: np.ndarray) -> Iterator[pd.DataFrame]:
        block = (f >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(f) else np.array([], int)
        ends = np.r_[starts[1:], len(f)]
        rest = f & np.uint64((1 << (64 - bits)) - 1)
        for i in range(0, len(starts), 4096):
            part = list(zip(starts[i : i + 4096], ends[i : i + 4096]))
            yield pd.DataFrame(
                {
                    "block": [int(block[a]) for a, _ in part],
                    "remainders": [rest[a:b].tobytes() for a, b in part],
                    "counters": [c[a:b].tobytes() for a, b in part],
                }
            )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, c = np.array([], np.uint64), np.array([], np.int64)
        waiting: list[np.ndarray] = []
        held = 0
        for b in batches:
            waiting.append(b["fp"].to_numpy(np.int64).view(np.uint64))
            held += len(b)
            if held >= 1 << 18:
                f, c = runs(np.concatenate([f, *waiting]), np.concatenate([c, np.ones(held, np.int64)]))
                waiting, held = [], 0
                if len(f) >= most:
                    yield from emit(f, c)
                    f, c = f[:0], c[:0]
        f, c = runs(np.concatenate([f, *waiting]), np.concatenate([c, np.ones(held, np.int64)]))
        yield from emit(f, c)

    return build


def merge_blocks(bits: int):
    """Merges all runs of one block by sorted remainders; keeps fingerprints counted more than once."""

    def merge(key: tuple, runs_of: pd.DataFrame) -> pd.DataFrame:
        rest, counters = runs(
            np.concatenate([np.frombuffer(x, np.uint64) for x in runs_of["remainders"]]),
            np.concatenate([np.frombuffer(x, np.int64) for x in runs_of["counters"]]),
        )
        more = counters > 1
        fp = rest[more] | (np.uint64(key[0]) << np.uint64(64 - bits))
        return pd.DataFrame({"fp": fp.view(np.int64), "n": counters[more]})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n): 64-bit fingerprints that stand in more than one row, with their exact counts."""
    bits = quotient_bits(rows)
    filters = fingerprints.select("fp").mapInPandas(partition_filter(bits), FILTER_SCHEMA)
    return filters.groupBy("block").applyInPandas(merge_blocks(bits), "fp long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Marks exact copies: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Texts are equal when their bytes are; null counts as empty, and empty texts are equal.
    Of equal texts the row with the largest id stays. Rows that repeat both id and text
    of the row that stays tie: all of them carry kept = true and count in group_size
    (`without_copies` leaves one). A null id never wins against another; a group with
    null ids alone keeps null. An empty input gives an empty result. Other columns of
    the input are not read.

    Fingerprints that hold a 4096th of all rows or more (at most 4096 of them, so a
    broadcast is bounded) are compared where they stand, after a partial aggregation;
    others are shuffled, and none of these fills a task.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    source = source.withColumn("fp", F.xxhash64("body"))
    marks = cut(source.select("doc_id", "fp", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")), "marks")
    total = marks.count()
    repeated = cut(repeated_fingerprints(marks, total), "repeated")
    heavy = F.broadcast(heavy_keys(repeated, "fp", total))

    suspects = source.join(heavy, "fp", "left_semi").unionByName(
        source.join(heavy, "fp", "left_anti").join(repeated.join(heavy, "fp", "left_anti").select("fp"), "fp", "left_semi")
    )
    same_bytes = suspects.groupBy("fp", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(
        same_bytes.select("fp", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "groups"
    )
    big = F.broadcast(groups.join(heavy, "fp", "left_semi").withColumnsRenamed({"keep_id": "big_id", "group_size": "big_size"}))
    rest = groups.join(heavy, "fp", "left_anti")
    keys = ["fp", "text_sha256"]
    one = marks.join(big, keys, "left")
    hot = one.where(F.col("big_size").isNotNull()).select(
        "doc_id", F.col("big_id").alias("keep_id"), F.col("big_size").alias("group_size"), "text_sha256"
    )
    cold = (
        one.where(F.col("big_size").isNull())
        .join(rest, keys, "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            "text_sha256",
        )
    )
    both = hot.unionByName(cold)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all their columns; of rows that tie in id and text, one.

    The decisions are narrow (an id and a digest), and the rows they concern are found by
    both, so a repeated id with another text is decided by its own text.
    """
    verdicts = cut(exact_duplicates(docs, id_col, text_col), "verdicts")
    key = [F.col("doc_id").alias("_leave_id"), F.unhex("text_sha256").alias("_leave_sha")]
    going = verdicts.where("not kept").select(*key).distinct()
    ties = verdicts.where("kept and group_size > 1").groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    return leave_out(docs, going, ties, F.col(id_col).cast("long").eqNullSafe(F.col("_leave_id")) & (sha == F.col("_leave_sha")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
