"""From raw documents to token ids: good texts, each once, free of benchmark questions, encoded.

Stages take what the one before kept, as Parquet in the shared folder. All but the last keep
the columns of documents. Nulls in any column, empty and very long texts, ties, repeated rows, empty tables
and more columns have the results that the operators named below state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from regdelta.llm.bpe import round_trip
from regdelta.llm.common import table
from regdelta.llm.decontaminate import without_contaminated
from regdelta.llm.exact_dedup import without_copies
from regdelta.llm.quality import good_documents
from regdelta.llm.simhash import without_near_copies
from regdelta.storage import passing_tables, remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (`good_documents`: score of 0.7 or more; empty texts are scored too)."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id (`without_copies`: null counts as empty, of rows alike in id and text one stays)."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose fingerprints are linked, the row with the smallest id."""
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    return round_trip(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", encode),
]

#: The quality scores and the fingerprints' components cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. Each is written to the shared folder; what it cut on the way, and what the stage before wrote, is removed then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with passing_tables(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
