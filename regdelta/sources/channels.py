"""A writer that hands planned alerts to their channels, each once, also when tasks die and are run again.

`plan.write.format("alert_channel").option("path", folder).option("job", name).option("senders", "module:NAME")`. Every row has a key, its alert and
attempt. A task notes in the journal of its partition that it is about to send, sends, and notes what came of it. A task that is
run again reads the journal first: what is noted as sent or failed is not tried again, and what was begun without an end is `uncertain`:
it may have gone out, so it is not sent a second time but reported. Results are files of the tasks; the driver gets their names and counts,
and marks the job as done. The input has to be a table, so that a partition has the same rows again, and tasks must not run twice at
a time (no speculation). The folder needs a file system that can append.
"""

from __future__ import annotations

import importlib
import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from regdelta import constants as C
from regdelta.functions.entity import retry_at
from regdelta.shipping import ship

RESULT = "alert_id string, attempt int, outcome string, error string"


class ChannelError(Exception):
    """The channel refused a message or could not be reached: it is tried again later."""


class _Journal:
    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def known(self) -> dict[str, dict]:
        """The last note of each key; a line that a dying task left unfinished is not one."""
        if self.fs.get_file_info(self.path).type == fs.FileType.NotFound:
            return {}
        with self.fs.open_input_stream(self.path) as f:
            lines = f.read().decode().split("\n")
        notes = {}
        for line in lines:
            try:
                note = json.loads(line)
            except ValueError:
                continue
            notes[note["key"]] = note
        return notes

    def note(self, **note) -> None:
        # opened anew each time: closing is what makes the line last
        with self.fs.open_append_stream(self.path) as f:
            f.write(("\n" + json.dumps(note) + "\n").encode())

    def replace(self, path: str, lines: list[str]) -> None:
        with self.fs.open_output_stream(path) as f:
            f.write("".join(x + "\n" for x in lines).encode())


@dataclass
class Sent(WriterCommitMessage):
    file: str
    outcomes: dict[str, int]


class ChannelWriter(DataSourceWriter):
    def __init__(self, path: str, job: str, senders: str):
        self.path, self.job, self.senders = path.rstrip("/"), job, senders

    def _senders(self) -> dict[str, Callable[[Row], None]]:
        module, _, name = self.senders.partition(":")
        return getattr(importlib.import_module(module), name)

    def write(self, rows: Iterator[Row]) -> Sent:
        senders, part = self._senders(), TaskContext.get().partitionId()
        journal = _Journal(f"{self.path}/journal/{self.job}/{part:06d}")
        journal.fs.create_dir(journal.path.rpartition("/")[0], recursive=True)
        known, results = journal.known(), []
        for row in rows:
            key = f"{row.alert_id}:{row.attempt}"
            note = known.get(key)
            if note is None:
                send = senders.get(row.channel)
                if send is None:
                    note = {"outcome": "unroutable", "error": f"unknown channel {row.channel}"}
                else:
                    journal.note(key=key, outcome="uncertain", error="the task died while it was sending")
                    try:
                        send(row)
                        note = {"outcome": "sent", "error": None}
                    except ChannelError as e:
                        note = {"outcome": "failed", "error": str(e)[:500]}
                    journal.note(key=key, **note)
            results.append({"alert_id": row.alert_id, "attempt": row.attempt, "outcome": note["outcome"], "error": note["error"]})
        folder = f"{journal.path.rpartition('/journal/')[0]}/results/{self.job}"
        journal.fs.create_dir(folder, recursive=True)
        journal.replace(f"{folder}/{part:06d}.json", [json.dumps(r) for r in results])
        return Sent(f"{part:06d}.json", dict(Counter(r["outcome"] for r in results)))

    def commit(self, messages: list[Sent | None]) -> None:
        total = Counter()
        for m in messages:
            total.update(m.outcomes if m else {})
        journal = _Journal(f"{self.path}/done-{self.job}")
        journal.replace(journal.path, [json.dumps(total)])

    def abort(self, messages: list[Sent | None]) -> None:
        """The journal stays: the job is to be run again under its name."""


class AlertChannel(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alert_channel"

    def schema(self) -> str:
        return "alert_id string, attempt int, channel string, recipient string, subject string, body string"

    def writer(self, schema, overwrite: bool) -> ChannelWriter:
        missing = {"alert_id", "attempt", "channel", "recipient"} - set(schema.fieldNames())
        if missing or not {"path", "job", "senders"} <= set(self.options):
            raise ValueError(f"missing columns {sorted(missing)}, or one of the options path, job and senders")
        return ChannelWriter(self.options["path"], self.options["job"], self.options["senders"])


def deliver(plan: DataFrame, path: str, job: str, senders: str) -> DataFrame:
    """Sends plan (a table: alert_id, attempt, channel, recipient and what the senders read) and returns its RESULT rows. Run again under the same name, it goes on."""
    spark: SparkSession = plan.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("speculative tasks could send twice: unset spark.speculation")
    ship(spark)
    spark.dataSource.register(AlertChannel)
    plan.write.format("alert_channel").mode("append").option("path", path).option("job", job).option("senders", senders).save()
    return spark.read.schema(RESULT).json(f"{path.rstrip('/')}/results/{job}")


def settle(alerts: DataFrame, results: DataFrame, now: Column, most: int = C.Config.delivery_retries) -> DataFrame:
    """alerts after a delivery: delivered_at, delivery_error and delivery_attempts of those that were tried, and when a failed one is due again.

    An uncertain one has no next attempt: someone has to look. One that was tried `most` times has none either.
    """
    r = results.select("alert_id", F.col("outcome").alias("_o"), F.col("error").alias("_e"))
    out = alerts.join(r, "alert_id", "left")
    tried = F.col("_o").isNotNull()
    attempts = F.col("delivery_attempts") + tried.cast("int")
    again = (F.col("_o") == "failed") & (attempts < most)
    return out.withColumns(
        {
            "delivered_at": F.when(F.col("_o") == "sent", now).otherwise(F.col("delivered_at")),
            "delivery_error": F.when(tried, F.col("_e")).otherwise(F.col("delivery_error")),
            "next_attempt_at": F.when(again, retry_at(now, attempts - 1, C.RETRY_BASES["deliver"], most)),
            "delivery_attempts": attempts,
        }
    ).drop("_o", "_e")
