"""Landing, content filter, version history and change events."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdelta import constants as C
from regdelta.functions import text as X
from regdelta.functions.entity import artifact_key
from regdelta.operators.store import BucketStore
from regdelta.shipping import ship
from regdelta.storage import cut


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in that order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def since(df: DataFrame, column: str, spec: str, as_of: Column) -> DataFrame:
    """Rows of the last 15m, 24h, 7d or 2w before as_of."""
    m = re.fullmatch(r"(\d+)([mhdw])", spec.strip())
    if not m:
        raise ValueError(f"bad duration: {spec!r}")
    seconds = int(m[1]) * {"m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]]
    return df.where(F.unix_timestamp(column) >= F.unix_timestamp(as_of) - seconds)


def content_filter(docs: DataFrame, cfg: C.Config = C.Config()) -> DataFrame:
    """Adds passed, reason, word_count, keyword_hits, density, structural, marker."""
    corpus = X.strip(F.concat(F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit("\n\n"))).otherwise(""), F.coalesce("raw_text", F.lit(""))))
    df = docs.withColumn("_corpus", corpus)
    tokens = F.regexp_extract_all(F.lower("_corpus"), F.lit(C.WORD_PATTERN), 0)
    df = df.withColumn("_tokens", tokens).withColumn("_marker", X.structural_marker(F.col("_corpus")))
    hits = F.size(F.array_intersect(F.col("_tokens"), F.array(*map(F.lit, C.REGULATORY_WORDS))))
    for phrase in C.REGULATORY_PHRASES:
        hits = hits + F.lower("_corpus").contains(phrase).cast("int")
    df = df.withColumn("word_count", F.size("_tokens")).withColumn("keyword_hits", hits).withColumn("structural", F.col("_marker") != "")
    n, h = F.col("word_count"), F.col("keyword_hits")
    density = F.try_divide(h, n)
    reason = (
        F.when(F.col("_corpus") == "", "empty")
        .when(F.col("structural") & (n >= cfg.dense_min_words), "structural_marker")
        .when((n >= cfg.dense_min_words) & (h >= cfg.filter_min_hits) & (density >= cfg.dense_min_density), "dense_short")
        .when(n < cfg.filter_min_words, "too_short")
        .when(h < cfg.filter_min_hits, "no_regulatory_keywords")
        .when(density < cfg.filter_min_density, "low_keyword_density")
        .otherwise("passed")
    )
    out = df.withColumn("reason", reason).withColumn("passed", F.col("reason").isin("structural_marker", "dense_short", "passed"))
    return out.withColumn("density", F.round(density, 4)).withColumn("marker", F.left("_marker", F.lit(40))).drop("_corpus", "_tokens", "_marker")


def apply_content_filter(docs: DataFrame, enabled: bool = True) -> DataFrame:
    return content_filter(docs).where("passed").select(*docs.columns) if enabled else docs


def event_key(*parts) -> F.Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def detect_changes(observations: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """One row per kept observation with outcome created, modified or unchanged, its event id and the previous text.

    Rows without url, hash or text are skipped. A text that was seen at the url before is
    unchanged, whenever that was; a new one is compared with the observation before it.
    versions: earlier history, which comes before all batches.
    """
    columns = ["source_url", "content_hash", "raw_text", "batch", "seq"]
    kept = observations.where("source_url is not null and content_hash is not null and raw_text is not null")
    if versions is not None:
        past = versions.select("source_url", "content_hash", "raw_text", F.lit(-1).alias("batch"), F.unix_micros("last_seen_at").alias("seq"))
        kept = kept.unionByName(past, allowMissingColumns=True)
    by_time = Window.partitionBy("source_url").orderBy("batch", "seq")
    again = Window.partitionBy("source_url", "content_hash").orderBy("batch", "seq")
    df = kept.withColumns(
        {
            "prev_hash": F.lag("content_hash").over(by_time),
            "prev_text": F.lag("raw_text").over(by_time),
            "_seen": F.row_number().over(again),
        }
    )
    outcome = F.when(F.col("_seen") > 1, "unchanged").when(F.col("prev_hash").isNull(), "created").otherwise("modified")
    df = df.withColumn("outcome", outcome).withColumn("event_id", event_key("source_url", "content_hash")).drop("_seen")
    assert set(columns) <= set(df.columns)
    return df.where("batch >= 0")


DIFF = T.StructType([T.StructField("unified_diff", T.StringType()), T.StructField("added_chars", T.IntegerType()), T.StructField("removed_chars", T.IntegerType())])


@F.pandas_udf(DIFF)
def _diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(old, new):
        lines = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "previous", "current", n=3, lineterm=""))
        body = [x for x in lines if not x.startswith(("+++", "---"))]
        rows.append(("\n".join(lines), sum(len(x) - 1 for x in body if x[0] == "+"), sum(len(x) - 1 for x in body if x[0] == "-")))
    return pd.DataFrame(rows, columns=["unified_diff", "added_chars", "removed_chars"])


def unified_diff(old: F.Column, new: F.Column, cap: int = C.Config.diff_cap) -> tuple[F.Column, F.Column, F.Column]:
    """(diff, added, removed); a long diff keeps its two ends."""
    d = _diff(old, new)
    text = d["unified_diff"]
    marker = F.concat(F.lit("\n… [diff truncated — "), F.length(text).cast("string"), F.lit(" chars total] …\n"))
    short = F.when(F.length(text) <= cap, text).otherwise(F.concat(F.left(text, F.lit(cap // 2)), marker, F.right(text, F.lit(cap // 2))))
    return short, d["added_chars"], d["removed_chars"]


def change_events(detected: DataFrame) -> DataFrame:
    """Events of created and modified observations; diffs are worked out for modified ones alone."""
    ship(detected.sparkSession)
    common = ["event_id", "source_url", "content_hash", "prev_hash", "diff_kind", "detected_at", "doc_id", "batch"]
    base = detected.where("outcome <> 'unchanged'").withColumnsRenamed({"outcome": "diff_kind", "fetched_at": "detected_at"})
    made = base.where("diff_kind = 'created'").select(
        *common, F.lit(None).cast("string").alias("unified_diff"), F.length("raw_text").alias("added_chars"), F.lit(0).alias("removed_chars")
    )
    text, added, removed = unified_diff(F.col("prev_text"), F.col("raw_text"))
    changed = base.where("diff_kind = 'modified'").select(*common, text.alias("unified_diff"), added.alias("added_chars"), removed.alias("removed_chars"))
    return made.unionByName(changed)


def plain_events(detected: DataFrame) -> DataFrame:
    """Events without their diffs."""
    return detected.where("outcome <> 'unchanged'").select(
        "event_id", "source_url", "content_hash", "prev_hash", F.col("outcome").alias("diff_kind"), F.col("fetched_at").alias("detected_at"), "doc_id", "batch"
    )


def version_history(observations: DataFrame) -> DataFrame:
    """One row per (url, hash): what its first observation had, and when it was seen first and last."""
    kept = observations.where("source_url is not null and content_hash is not null and raw_text is not null")
    first = F.min_by(F.struct("source_type", "title", "language", "raw_text", "doc_id"), F.struct("batch", "seq"))
    out = kept.groupBy("source_url", "content_hash").agg(first.alias("f"), F.min("fetched_at").alias("first_seen_at"), F.max("fetched_at").alias("last_seen_at"))
    return out.select(event_key("source_url", "content_hash").alias("version_id"), "source_url", "content_hash", "f.*", "first_seen_at", "last_seen_at")


def latest_versions(versions: DataFrame) -> DataFrame:
    return first_by(versions, ["source_url"], [F.desc("last_seen_at"), F.desc("content_hash")])


def change_counts(detected: DataFrame) -> DataFrame:
    return detected.groupBy("batch", "outcome").agg(F.count("*").alias("n"))


def upsert_documents(state: DataFrame | None, batch: DataFrame, now: F.Column) -> DataFrame:
    """State after the batch: a new hash adds its first row of the batch, a known one only moves last_seen_at.

    Adds `outcome`: inserted, updated or kept, and `repeats`: rows of the batch with that hash.
    """
    columns = ["content_hash", "source_url", "source_type", "title", "language", "raw_text", "fetched_at"]
    counted = batch.groupBy("content_hash").agg(F.count("*").alias("repeats"), F.min_by(F.struct(*columns[1:]), "seq").alias("r"))
    news = counted.select("content_hash", "repeats", "r.*")
    if state is None:
        return news.withColumn("last_seen_at", now).withColumn("outcome", F.lit("inserted"))
    old = state.select(*columns, "last_seen_at")
    a, b = old.alias("a"), news.alias("b")
    joined = a.join(b, F.col("a.content_hash") == F.col("b.content_hash"), "full_outer")
    known = F.col("a.content_hash").isNotNull()
    picked = [F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns]
    seen = F.when(F.col("b.content_hash").isNotNull(), now).otherwise(F.col("a.last_seen_at"))
    outcome = F.when(~known, "inserted").when(F.col("b.content_hash").isNotNull(), "updated").otherwise("kept")
    return joined.select(*picked, F.coalesce("b.repeats", F.lit(0)).alias("repeats"), seen.alias("last_seen_at"), outcome.alias("outcome"))


DOCUMENTS = "content_hash string, source_url string, source_type string, title string, language string, raw_text string, fetched_at timestamp, last_seen_at timestamp, outcome string, repeats bigint"


def keep_documents(store: BucketStore, number: int, batch: DataFrame, now: F.Column) -> DataFrame:
    """Upserts a batch into a store of DOCUMENTS by content_hash; (content_hash, outcome, repeats) of the hashes of the batch.

    Only buckets with a hash of the batch are read and written; texts of other buckets are not touched.
    """
    rows = cut(batch.where("content_hash is not null"), "batch")
    after = store.apply(number, rows, lambda known, new: upsert_documents(known, new, now))
    return after.join(rows.select("content_hash").distinct(), "content_hash", "left_semi").select("content_hash", "outcome", "repeats")


def archive_keys(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Adds artifact_uri: that of an archived hash (which may be null), else a new key."""
    have = known.select("content_hash", F.col("artifact_uri").alias("_uri"), F.lit(True).alias("_known"))
    new = artifact_key(F.col("source_type"), F.col("fetched_at"), F.col("content_hash"))
    joined = batch.drop("artifact_uri").join(have, "content_hash", "left")
    return joined.withColumn("artifact_uri", F.when(F.col("_known"), F.col("_uri")).otherwise(new)).withColumn("reused", F.coalesce("_known", F.lit(False))).drop("_uri", "_known")


def promote_and_create(docs: DataFrame, versions: DataFrame, events: DataFrame) -> DataFrame:
    """(source_url, content_hash, provenance): existing, created or promoted+created for each raw document."""
    d = docs.select("source_url", "content_hash").distinct()
    v = versions.select("source_url", "content_hash").distinct().withColumn("_v", F.lit(True))
    e = events.select("source_url", "content_hash").distinct().withColumn("_e", F.lit(True))
    out = d.join(v, ["source_url", "content_hash"], "left").join(e, ["source_url", "content_hash"], "left")
    how = F.when(F.col("_v").isNull(), "promoted+created").when(F.col("_e").isNull(), "created").otherwise("existing")
    return out.select("source_url", "content_hash", how.alias("provenance"))
