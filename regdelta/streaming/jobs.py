"""The same operators over streams: ingest, version tracking, dedup, rolling counts, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from regdelta.operators.alerts import plan_delivery
from regdelta.operators.changes import apply_content_filter, event_key
from regdelta.operators.matching import match_events, new_alerts
from regdelta.operators.store import BucketStore
from regdelta.shipping import ship
from regdelta.storage import cut

TRACKED = "source_url string, content_hash string, prev_hash string, outcome string, batch int, seq long"


class VersionTracker(StatefulProcessor):
    """For each url: the hashes seen, and the last one. Emits created, modified or unchanged for every observation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "content_hash string", "seq long")
        self.last = handle.getValueState("last", "content_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["batch", "seq"], kind="stable")
        out = []
        for r in batch.itertuples():
            prev = self.last.get()[0] if self.last.exists() else None
            known = self.seen.containsKey((r.content_hash,))
            out.append((key[0], r.content_hash, prev, "unchanged" if known else "created" if prev is None else "modified", r.batch, r.seq))
            self.seen.updateValue((r.content_hash,), (int(r.seq),))
            self.last.update((r.content_hash,))
        yield pd.DataFrame(out, columns=["source_url", "content_hash", "prev_hash", "outcome", "batch", "seq"])

    def close(self) -> None:
        pass


def track_versions(stream: DataFrame) -> DataFrame:
    """Needs the RocksDB state store; batches of a url must arrive in order."""
    ship(stream.sparkSession)
    rows = stream.where("source_url is not null and content_hash is not null").select("source_url", "content_hash", "batch", "seq")
    return rows.groupBy("source_url").transformWithStateInPandas(VersionTracker(), outputStructType=TRACKED, outputMode="Append", timeMode="None")


BREAKER = "scope string, ts timestamp, failures int, open_until timestamp"


class Breaker(StatefulProcessor):
    """For each scope: the failures of the last window. Emits each failure with their count, and until when the breaker is open then.

    A timer clears a scope that has been quiet for the window, so its state does not stay.
    """

    def __init__(self, seconds: int = 60, threshold: int = 10, cooldown: int = 300):
        self.window, self.threshold, self.cooldown = seconds * 1000, threshold, cooldown * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ms long")
        self.open = handle.getValueState("open", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(int(t.timestamp() * 1000) for b in rows for t in b["ts"])
        kept = [t for (t,) in self.times.get()] if self.times.exists() else []
        until = self.open.get()[0] if self.open.exists() else None
        out = []
        for t in new:
            kept = [x for x in kept if x > t - self.window] + [t]
            if len(kept) >= self.threshold:
                until = t + self.cooldown
            out.append((key[0], pd.Timestamp(t, unit="ms"), len(kept), pd.Timestamp(until, unit="ms") if until and until > t else pd.NaT))
        self.times.put([(t,) for t in kept])
        if until is not None:
            self.open.update((until,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(kept[-1] + self.window, until or 0) + 1)
        yield pd.DataFrame(out, columns=["scope", "ts", "failures", "open_until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.open.clear()
        yield pd.DataFrame({"scope": [], "ts": [], "failures": [], "open_until": []})

    def close(self) -> None:
        pass


def breaker_stream(failures: DataFrame, seconds: int = 60, threshold: int = 10, cooldown: int = 300, late: str = "10 seconds") -> DataFrame:
    """failures: scope, ts. Needs the RocksDB state store."""
    ship(failures.sparkSession)
    rows = failures.where("scope is not null").select("scope", "ts").withWatermark("ts", late)
    return rows.groupBy("scope").transformWithStateInPandas(Breaker(seconds, threshold, cooldown), outputStructType=BREAKER, outputMode="Append", timeMode="EventTime")


ALERT_KEYS = "subscription_id bigint, event_id string"


def alert_batch(texts_of: Callable[[DataFrame], DataFrame], subs: DataFrame, alerts_path: str, outbox_path: str | None = None, buckets: int = 64, earlier: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Matches a micro-batch of scored events with the rules; alerts that a former batch wrote are not made again.

    Each batch has a folder of its own number. The keys of all alerts are kept in hash buckets by event: a batch
    reads those that its events fall in, however many batches were before. earlier: (subscription_id, event_id) of alerts from before the
    stream. outbox_path: alerts whose plan is to send go there as well, with their recipient; subs then has user_email,
    channel and channel_target too.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = BucketStore(spark, f"{alerts_path}/_keys", ALERT_KEYS, "event_id", buckets, earlier is not None)
        if earlier is not None and number == 0:
            made.seed(earlier.select(F.col("subscription_id").cast("long").alias("subscription_id"), "event_id").distinct())
        past = made.near(number, batch).join(batch.select("event_id").distinct(), "event_id", "left_semi").select("subscription_id", "event_id")
        fresh = cut(new_alerts(match_events(batch, texts_of(batch), subs), past), "alerts")
        fresh.write.mode("overwrite").parquet(f"{alerts_path}/batch={number}")
        if outbox_path:
            untried = fresh.withColumns({"delivered_at": F.lit(None).cast("timestamp"), "delivery_attempts": F.lit(0), "created_at": F.current_timestamp()})
            due = plan_delivery(untried, subs, batch).where("plan = 'to_send'")
            due.select("alert_id", "subscription_id", "event_id", "recipient").write.mode("overwrite").parquet(f"{outbox_path}/batch={number}")
        made.apply(number, fresh.select(F.col("subscription_id").cast("long").alias("subscription_id"), "event_id"), lambda known, new: known.unionByName(new))

    return run


def dedup_stream(stream: DataFrame, horizon: str = "7 days") -> DataFrame:
    """First arrival of each hash within the horizon."""
    return stream.withWatermark("fetched_at", horizon).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_blocks(stream: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", window, slide)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "domain").agg(F.count("*").alias("blocks")).select("domain", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "blocks")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a table job on every micro-batch that is there, then stops."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


KNOWN = "source_url string, content_hash string, batch int, seq bigint"


def _last_seen(rows: DataFrame) -> DataFrame:
    """Each hash of a url where it was seen last."""
    return rows.groupBy("source_url", "content_hash").agg(F.max(F.struct("batch", "seq")).alias("at")).select("source_url", "content_hash", "at.*")


def ingest_batch(state_path: str, events_path: str, filtered: bool = False, buckets: int = 64, earlier: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Content filter (if wanted) and change detection of a micro-batch against what was seen so far; new texts go to `events_path`.

    The state is hashes, not texts, in hash buckets by url: a batch reads and rewrites those that its urls fall in, so that batch
    1,000 does what batch 10 does. A batch that is replayed reads what batches before it wrote, and writes the same rows to the same
    place. earlier: KNOWN rows from before the stream, as `seen_versions` makes them. Rows of a batch that pass are kept once, by the
    changes that they make; a text seen before adds nothing but its time.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        passed = apply_content_filter(batch, filtered).where("source_url is not null and content_hash is not null and raw_text is not null")
        seen = BucketStore(spark, state_path, KNOWN, "source_url", buckets, earlier is not None)
        if earlier is not None and number == 0:
            seen.seed(earlier)
        places = cut(_last_seen(passed.select("source_url", "content_hash", F.col("batch").cast("int").alias("batch"), F.col("seq").cast("long").alias("seq"))), "places")
        near = seen.near(number, places).join(places.select("source_url").distinct(), "source_url", "left_semi")
        now = passed.withColumn("_now", F.lit(True)).unionByName(near.withColumn("_now", F.lit(False)), allowMissingColumns=True)
        by_time = Window.partitionBy("source_url").orderBy("_now", "batch", "seq")
        again = Window.partitionBy("source_url", "content_hash").orderBy("_now", "batch", "seq")
        marked = now.withColumns({"prev_hash": F.lag("content_hash").over(by_time), "_seen": F.row_number().over(again)})
        outcome = F.when(F.col("prev_hash").isNull(), "created").otherwise("modified").alias("outcome")
        found = marked.where("_now and _seen = 1").select(event_key("source_url", "content_hash").alias("event_id"), "source_url", "content_hash", "prev_hash", outcome, "batch", "seq", "raw_text")
        found.write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        seen.apply(number, places, lambda known, new: _last_seen(known.unionByName(new)))

    return run


def seen_versions(versions: DataFrame) -> DataFrame:
    """KNOWN rows of a version history, as batch -1, in the order of their last times."""
    return versions.select("source_url", "content_hash", F.lit(-1).alias("batch"), F.unix_micros("last_seen_at").alias("seq"))
