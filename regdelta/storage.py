"""The folder that driver and executors share, and tables written there to start later jobs from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
_passing: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A local session without one gets a temporary folder; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="regdelta-")
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs start from those files, not from its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/regdelta-{label}-{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder, by the file system that Spark reaches it with."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut within go at the end. What is to last has to be written elsewhere by then."""
    own: list[str] = []
    _passing.append(own)
    try:
        yield
    finally:
        _passing.remove(own)
        for path in own:
            remove(spark, path)
