"""Places in an order that no single task puts in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdelta.storage import cut

#: monotonically_increasing_id has the partition above this bit and the row of the partition below it.
_ROW_BITS = 33


def _lying(rows: DataFrame, order: list[Column], columns: list) -> DataFrame:
    """columns of rows as a table, dealt by range and sorted where they lie; _lies tells where that is."""
    lying = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(lying.select(*columns, F.monotonically_increasing_id().alias("_lies")), "lying")


def numbered(rows: DataFrame, order: list[Column], name: str = "place", columns: list | None = None) -> DataFrame:
    """columns (by default all) of rows with their place in the order, from 1, as a table in the shared folder.

    Rows are dealt by range and sorted where they lie; the places follow from the counts of the partitions
    before. Rows of one key are as many tasks as they need if the order goes on to tell them apart. Rows that tie in the
    whole order get places in any order, so end it with a column that differs where that matters.
    """
    lying = _lying(rows, order, columns or rows.columns)
    part = F.shiftright("_lies", _ROW_BITS)
    counts = lying.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = lying.join(F.broadcast(before), part == F.col("_part"))
    row = F.col("_lies").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(name, F.col("_before") + row + 1).drop("_lies", "_part", "_before")


def running_total(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to each in the order. Rows that tie in the whole order get theirs in any order.

    Sums run within the ranges that the rows are dealt by; those of the ranges before are added.
    """
    lying = _lying(rows, order, rows.columns).withColumn("_part", F.shiftright("_lies", _ROW_BITS))
    sums = lying.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_lies").rowsBetween(Window.unboundedPreceding, 0))
    return lying.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_lies", "_part", "_before", "_own")
