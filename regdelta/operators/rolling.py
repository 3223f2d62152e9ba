"""Rolling counts over event time, breaker intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdelta.operators.ranks import running_total
from regdelta.storage import cut


#: Rows of a key in one window from which on they are counted by running totals.
HOT_ROWS = 1 << 20


def rolling_count(rows: DataFrame, key: str, ts: str, seconds: int, name: str, hot: int = HOT_ROWS) -> DataFrame:
    """Adds the count of the key's rows in the last `seconds` up to each row; a row exactly that old is out.

    Time is cut in buckets as long as the window. A row goes to its own and to the next bucket, where it
    is only counted, so that a key with most of the rows is many groups. A key that has more than `hot` rows in some
    bucket, which would be one task, is counted by running totals over ranges instead; the counts are the same.
    """
    length = seconds * 1_000_000
    bucket = F.floor(F.unix_micros(ts) / length)
    full = rows.where(F.col(ts).isNotNull()).groupBy(key, bucket.alias("_bucket")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    full = cut(full.select(F.col(key).alias("_key")).distinct(), "hot")
    if full.isEmpty():
        return _by_buckets(rows, key, ts, length, bucket, name)
    # a key has more than `hot` rows each, so they are few
    is_hot = F.col(key).eqNullSafe(F.col("_key")) & F.col(ts).isNotNull()
    rest = _by_buckets(rows.join(F.broadcast(full), is_hot, "left_anti"), key, ts, length, bucket, name)
    return rest.unionByName(_by_totals(rows.join(F.broadcast(full), is_hot, "left_semi"), key, ts, length, name))


def _by_buckets(rows: DataFrame, key: str, ts: str, length: int, bucket: Column, name: str) -> DataFrame:
    """In a bucket: the rows of the bucket before, less those that have left the window by then, and its own up to then.

    These are running sums, one step a row; a frame that slides would be read anew for every row.
    """
    at = F.unix_micros(ts)
    mark = lambda gone: F.struct(F.lit(gone).alias("gone"), (bucket + gone).alias("bucket"), (at + gone * length).alias("at"))
    spread = rows.withColumn("_mark", F.explode(F.array(mark(0), mark(1))))
    spread = spread.select(*rows.columns, F.col("_mark.gone").alias("_gone"), F.col("_mark.bucket").alias("_bucket"), F.col("_mark.at").alias("_at"))
    w = Window.partitionBy(key, "_bucket").orderBy("_at")
    before = F.sum("_gone").over(w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    change = F.sum(1 - 2 * F.col("_gone")).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return spread.withColumn(name, before + change).where("_gone = 0").drop("_gone", "_bucket", "_at")


def _by_totals(rows: DataFrame, key: str, ts: str, length: int, name: str) -> DataFrame:
    """What came up to a time less what came up to the window's begin: both are running totals of one order by key and time."""
    times = cut(rows.groupBy(F.col(key).alias("_key"), F.unix_micros(ts).alias("_at")).agg(F.count("*").alias("_n")), "times")
    ends = times.select("_key", "_at", "_n", F.col("_at").alias("_of"), F.lit(0).alias("_kind"))
    begins = times.select("_key", (F.col("_at") - length).alias("_at"), F.lit(0).cast("long").alias("_n"), F.col("_at").alias("_of"), F.lit(1).alias("_kind"))
    total = running_total(cut(ends.unionByName(begins), "marks"), [F.col("_key").asc_nulls_first(), F.col("_at"), F.col("_kind")], "_n", "_total")
    upto = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_total")))
    counts = total.groupBy("_key", "_of").agg((upto(0) - upto(1)).alias(name))
    return rows.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.unix_micros(ts) == F.col("_of"))).drop("_key", "_of")


def rolling_blocks(blocks: DataFrame, seconds: int = 86_400) -> DataFrame:
    return rolling_count(blocks, "domain", "ts", seconds, "blocks")


def block_status(blocks: DataFrame, as_of: Column, seconds: int = 86_400, order: str = "event_id") -> DataFrame:
    """(domain, blocks, last_reason) of the window before as_of: one row a domain that was blocked in it. Of equal times the greater order is the later."""
    age = F.unix_micros(as_of) - F.unix_micros("ts")
    recent = blocks.where((age >= 0) & (age < seconds * 1_000_000))
    return recent.groupBy("domain").agg(F.count("*").alias("blocks"), F.max_by("reason", F.struct("ts", order)).alias("last_reason"))


def rolling_failures(calls: DataFrame, seconds: int = 60, threshold: int = 10) -> DataFrame:
    """Failures of each scope with the count of its window, and whether that trips the breaker."""
    failures = rolling_count(calls.where("failed and scope is not null"), "scope", "ts", seconds, "failures")
    return failures.withColumn("tripped", F.col("failures") >= threshold)


def breaker_intervals(calls: DataFrame, seconds: int = 60, threshold: int = 10, cooldown: int = 300) -> DataFrame:
    """(scope, opened_at, open_until, trips): overlapping openings merged.

    Trips of one stretch as long as the cooldown overlap and are merged first; the stretches are put in order.
    """
    length = cooldown * 1_000_000
    trips = rolling_failures(calls, seconds, threshold).where("tripped").select("scope", F.unix_micros("ts").alias("t"))
    stretches = trips.groupBy("scope", F.floor(F.col("t") / length).alias("_stretch")).agg(F.min("t").alias("a"), (F.max("t") + length).alias("b"), F.count("*").alias("n"))
    order = Window.partitionBy("scope").orderBy("a")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = stretches.withColumn("_new", (before.isNull() | (F.col("a") > before)).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("scope", "_island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("trips"))
    return out.select("scope", F.timestamp_micros("a").alias("opened_at"), F.timestamp_micros("b").alias("open_until"), "trips")


def is_open(calls: DataFrame, intervals: DataFrame, seconds: int = 300) -> DataFrame:
    """Adds whether the breaker of a call's scope is open then.

    A scope's intervals are disjoint. They and the calls meet by scope and stretch of `seconds`; any length
    gives the same result, and at most one interval fits a call.
    """
    stretch = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    spread = intervals.select(F.col("scope").alias("_scope"), "opened_at", "open_until", F.explode(F.sequence(stretch("opened_at"), stretch("open_until"))).alias("_stretch"))
    fits = (F.col("scope") == F.col("_scope")) & (stretch("ts") == F.col("_stretch")) & (F.col("ts") >= F.col("opened_at")) & (F.col("ts") < F.col("open_until"))
    return calls.join(spread, fits, "left").withColumn("open", F.col("_scope").isNotNull()).select(*calls.columns, "open")
