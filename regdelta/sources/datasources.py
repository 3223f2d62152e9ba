"""Register and feed indexes as sources of `spark.read.format` and `spark.readStream.format`.

A folder holds one file a day (`2024-01-02.jsonl` for registers, `2024-01-02.xml` or `2024-01-02-name.xml` for feeds). Each file is a partition;
filters on `day` leave out files before any is opened, and a stream's offset is the name of the last file that it has read. The
folder is reached by pyarrow's file systems, so it may be local, HDFS or an object store that these know.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from regdelta.shipping import ship

_NAME = re.compile(r"(\d{4}-\d{2}-\d{2})[^/]*$")
_TESTS = {
    EqualTo: lambda day, v: day == v,
    GreaterThan: lambda day, v: day > v,
    GreaterThanOrEqual: lambda day, v: day >= v,
    LessThan: lambda day, v: day < v,
    LessThanOrEqual: lambda day, v: day <= v,
    In: lambda day, v: day in v,
}


class DayFile(InputPartition):
    def __init__(self, path: str, day: dt.date):
        self.path, self.day = path, day


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _DayFolder:
    """What batch and stream readers share: the files of a folder by name, and the rows of one of them."""

    def __init__(self, schema: StructType, path: str, suffix: str, parse):
        self.columns, self.path, self.suffix, self.parse = schema.fieldNames(), path, suffix, parse

    def files(self) -> list[DayFile]:
        store, root = _folder(self.path)
        found = [(i.base_name, i.path) for i in store.get_file_info(fs.FileSelector(root)) if i.is_file and i.base_name.endswith(self.suffix)]
        return [DayFile(p, dt.date.fromisoformat(m[1])) for name, p in sorted(found) if (m := _NAME.match(name))]

    def read(self, partition: DayFile) -> Iterator[tuple]:
        store, _ = _folder(self.path)
        with store.open_input_stream(partition.path) as source:
            for row in self.parse(source, partition.path):
                row["day"] = partition.day
                yield tuple(row.get(c) for c in self.columns)


class DayReader(_DayFolder, DataSourceReader):
    def __init__(self, *args):
        super().__init__(*args)
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("day",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[DayFile]:
        return [p for p in self.files() if all(_TESTS[kind](p.day, v) for kind, v in self.tests)]


class DayStream(_DayFolder, DataSourceStreamReader):
    """Files are taken in the order of their names; one that is named before the offset comes too late."""

    def _names(self) -> list[str]:
        return [p.path.rpartition("/")[2] for p in self.files()]

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[DayFile]:
        return [p for p in self.files() if start["after"] < p.path.rpartition("/")[2] <= end["after"]]

    def commit(self, end: dict) -> None:
        pass


def _register_rows(source: pa.NativeFile, path: str) -> Iterator[dict]:
    """JSON lines of a register's index; a line that is not JSON fails with its place."""
    for number, line in enumerate(io.BufferedReader(source), 1):
        if line.strip():
            try:
                row = json.loads(line)
            except ValueError as e:
                raise ValueError(f"{path}, line {number}: {e}") from None
            yield row | {"agencies": [(a or {}).get("raw_name") for a in row.get("agencies") or []]}


def _inner(item: ElementTree.Element, *names: str) -> str | None:
    """Text of the first child with one of the names, whatever its namespace."""
    for child in item:
        if child.tag.rpartition("}")[2] in names:
            text = "".join(child.itertext()).strip() or child.get("href")
            if text:
                return text
    return None


def _feed_rows(source: pa.NativeFile, path: str) -> Iterator[dict]:
    """Items of an RSS or Atom feed in order; items are let go as they are read."""
    pos, title, depth = 0, None, []
    for event, e in ElementTree.iterparse(source, ("start", "end")):
        name = e.tag.rpartition("}")[2]
        if event == "start":
            depth.append(name)
            continue
        depth.pop()
        if name == "title" and title is None and "item" not in depth and "entry" not in depth:
            title = (e.text or "").strip() or None
        if name in ("item", "entry"):
            yield {
                "feed_url": path, "feed_title": title, "pos": pos, "title": _inner(e, "title"), "link": _inner(e, "link"), "summary": _inner(e, "description", "summary"),
                "guid": _inner(e, "guid", "id"), "published": _inner(e, "pubDate", "published", "updated"),
            }
            pos += 1
            e.clear()


class _DaySource(DataSource):
    SCHEMA, SUFFIX, PARSE = "", "", None

    def schema(self) -> str:
        return self.SCHEMA

    def _args(self, schema: StructType) -> tuple:
        if "path" not in self.options:
            raise ValueError("give the folder as option path")
        return schema, self.options["path"], self.SUFFIX, type(self).PARSE

    def reader(self, schema: StructType) -> DayReader:
        return DayReader(*self._args(schema))

    def streamReader(self, schema: StructType) -> DayStream:
        return DayStream(*self._args(schema))


class RegisterSource(_DaySource):
    """`register_index`: what `register_to_documents` takes, agencies by their names."""

    SCHEMA = "day date, document_number string, title string, abstract string, type string, agencies array<string>, publication_date string, effective_on string, html_url string, body_html_url string"
    SUFFIX, PARSE = ".jsonl", staticmethod(_register_rows)

    @classmethod
    def name(cls) -> str:
        return "register_index"


class FeedSource(_DaySource):
    """`feed_index`: what `feed_items_to_documents` takes."""

    SCHEMA = "day date, feed_url string, feed_title string, pos int, title string, link string, summary string, guid string, published string"
    SUFFIX, PARSE = ".xml", staticmethod(_feed_rows)

    @classmethod
    def name(cls) -> str:
        return "feed_index"


def register_formats(spark: SparkSession) -> None:
    """Makes both known to the session, with filters pushed down to them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RegisterSource, FeedSource):
        spark.dataSource.register(source)
