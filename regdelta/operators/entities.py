"""The entity index kept over batches: entities and links that are merged, not made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdelta.operators.scoring import entity_links, entity_mentions
from regdelta.operators.store import BucketStore
from regdelta.storage import cut

_ORDER = "struct<detected_at:timestamp,doc_id:bigint,pos:int>"
#: What two parts of the mentions of an entity are merged from; the orders say which display and which type came first.
ENTITIES = f"key string, mention_count bigint, display_name string, named_at {_ORDER}, entity_type string, typed_at {_ORDER}, first_seen_at timestamp, last_seen_at timestamp"
LINKS = "event_id string, key string, mention_text string"


def entity_parts(mentions: DataFrame) -> DataFrame:
    """Mentions folded by key, as ENTITIES; entity_type is null while no type but other was met."""
    order = F.struct("detected_at", "doc_id", "pos")
    typed = F.when(F.col("type") != "other", order)
    return mentions.groupBy("key").agg(
        F.count("*").alias("mention_count"), F.min_by("display", order).alias("display_name"), F.min(order).alias("named_at"), F.min_by("type", typed).alias("entity_type"), F.min(typed).alias("typed_at"),
        F.min("detected_at").alias("first_seen_at"), F.max("detected_at").alias("last_seen_at"),
    )


def merge_entities(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both as ENTITIES: counts add up, the first display and the first type that is not other stay, times widen. In any order the same."""
    return known.unionByName(fresh).groupBy("key").agg(
        F.sum("mention_count").alias("mention_count"), F.min_by("display_name", "named_at").alias("display_name"), F.min("named_at").alias("named_at"), F.min_by("entity_type", "typed_at").alias("entity_type"), F.min("typed_at").alias("typed_at"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )


def stores(spark, path: str, buckets: int = 64) -> tuple[BucketStore, BucketStore]:
    """(entities, links) under path."""
    return BucketStore(spark, f"{path}/entities", ENTITIES, "key", buckets), BucketStore(spark, f"{path}/links", LINKS, "event_id", buckets)


def index_events(entities: BucketStore, links: BucketStore, number: int, events: DataFrame) -> DataFrame:
    """Indexes a batch of scored events; one row a batch event: event_id, status (indexed, empty), indexed (new links).

    Mentions of an (event, entity) that is linked already, by a batch before, add nothing; the links of
    the batch's events alone are read. Counts of entities that the batch names are merged where they lie.
    """
    mentions = entity_mentions(events)
    mentions = cut(mentions.join(links.near(number, mentions).select("event_id", "key"), ["event_id", "key"], "left_anti"), "mentions")
    new = cut(entity_links(mentions), "links")
    links.apply(number, new, lambda known, rows: known.unionByName(rows))
    entities.apply(number, cut(entity_parts(mentions), "parts"), merge_entities)
    made = new.groupBy("event_id").agg(F.count("*").alias("n"))
    empty = F.coalesce(F.size("affected_entities"), F.lit(0)) <= 0
    return events.select("event_id", F.when(empty, "empty").otherwise("indexed").alias("status")).join(made, "event_id", "left").select("event_id", "status", F.coalesce("n", F.lit(0)).cast("long").alias("indexed"))


def entity_table(entities: BucketStore, number: int) -> DataFrame:
    """The entities after a batch, as `sync_entities` has them; one of no known type is other."""
    out = entities.state(number)
    return out.select("key", "mention_count", "display_name", F.coalesce("entity_type", F.lit("other")).alias("entity_type"), "first_seen_at", "last_seen_at")
