"""A keyed table that is kept over batches: hash buckets, of which a batch reads and rewrites those alone that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketStore:
    """Rows by the hash of `key` in `buckets` buckets under `path`.

    Batch n writes the buckets that it touches to version=n, and at last a manifest, which tells for each bucket the version that
    it is in. It reads by the manifest of batch n - 1. So a batch that failed half way has changed nothing, one that is
    replayed writes the same again, and batch 1,000 reads as few files as batch 10. The manifest has a row for each bucket.
    Batches are numbered from 0 without gaps; `seed` puts rows of an earlier table in front of them. A key has one row or few, so hot keys of a batch are folded by `merge` before they are kept.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, seeded: bool = False):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.first = -1 if seeded else 0

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifest(self, number: int) -> dict[int, int]:
        """The version of each bucket after that batch."""
        if number < self.first:
            return {}
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/manifest={number}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/version={v}/_bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def state(self, number: int) -> DataFrame:
        """All rows after batch `number`; none before the first."""
        return self._read(self._manifest(number))

    def near(self, number: int, keys: DataFrame) -> DataFrame:
        """Rows before batch `number` of the buckets that the keys (a column named like the store's key) fall in."""
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
        return self._read({b: v for b, v in self._manifest(number - 1).items() if b in touched})

    def apply(self, number: int, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Batch `number`: merge(rows that are there, rows) is what their buckets hold from then on. Returns these, as written.

        rows is worked out twice: give a table. merge must keep the rows of other keys that it is given.
        """
        known = self._manifest(number - 1)
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())
        if touched:
            merged = merge(self._read({b: known[b] for b in touched if b in known}), rows)
            columns = self.spark.createDataFrame([], self.schema).columns
            target = merged.select(*columns, self._bucket().alias("_bucket")).repartition("_bucket")
            target.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/version={number}")
        now = known | dict.fromkeys(touched, number)
        manifest = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest={number}")
        return self._read(dict.fromkeys(touched, number))

    def seed(self, rows: DataFrame) -> None:
        """Rows (a table, each key as the store keeps it) that were there before batch 0. Later stores of this path are told `seeded`."""
        self.first = -1
        self.apply(-1, rows, lambda known, new: new)
