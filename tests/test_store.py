import random

from pyspark.sql import functions as F

from regdelta.operators import changes as G
from regdelta.operators import entities as I
from regdelta.operators.store import BucketStore


def test_batches_touch_their_buckets_alone_and_can_be_replayed(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "counts"), "k string, n bigint", "k", 16)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    rng, want = random.Random(4), {}
    for number in range(5):
        rows = [(f"k{rng.randrange(12)}", rng.randrange(5)) for _ in range(3 if number else 40)]
        batch = spark.createDataFrame(rows, "k string, n bigint")
        before = store._manifest(number - 1)
        for _ in range(2):  # replayed once
            written = store.apply(number, batch, add)
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        touched = {r[0] for r in batch.select(store._bucket()).distinct().collect()}
        now = store._manifest(number)
        assert {b for b, v in now.items() if v == number} == touched and all(now[b] == v for b, v in before.items() if b not in touched)
        assert {f.split("_bucket=")[1].split("/")[0] for f in written.inputFiles()} == {str(b) for b in touched}
        assert {r.k: r.n for r in store.state(number).collect()} == want
    assert store.state(-1).count() == 0


def test_a_batch_without_rows_changes_nothing(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), "k string", "k", 4)
    store.apply(0, spark.createDataFrame([("a",)], "k string"), lambda old, new: new)
    store.apply(1, spark.createDataFrame([], "k string"), lambda old, new: new)
    assert [r.k for r in store.state(1).collect()] == ["a"]


def test_documents_over_batches(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "docs"), G.DOCUMENTS, "content_hash", 8)
    schema = "content_hash string, source_url string, source_type string, title string, language string, raw_text string, fetched_at timestamp, seq long"
    batches = [[("a", 2), ("a", 1), ("b", 3), (None, 9)], [("b", 4), ("c", 5)], [("a", 6)]]
    said = []
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame([(h, f"u{s}", "web", None, None, f"t{s}", None, s) for h, s in rows], schema)
        out = G.keep_documents(store, n, frame, F.timestamp_seconds(F.lit(1000 + n)))
        said.append({r.content_hash: (r.outcome, r.repeats) for r in out.collect()})
    assert said == [{"a": ("inserted", 2), "b": ("inserted", 1)}, {"b": ("updated", 1), "c": ("inserted", 1)}, {"a": ("updated", 1)}]
    state = {r.content_hash: (r.source_url, r.seen) for r in store.state(2).select("*", F.unix_timestamp("last_seen_at").alias("seen")).collect()}
    assert state == {"a": ("u1", 1002), "b": ("u3", 1001), "c": ("u5", 1001)}


def test_parts_of_entities_merge_in_any_order(spark):
    schema = "event_id string, doc_id long, detected_at timestamp, pos int, surface string, key string, display string, type string"
    rng = random.Random(8)
    rows = [(f"e{i}", i, f"2024-01-0{rng.randrange(1, 9)} 00:00:00", 0, "s", rng.choice("xyz"), f"name {i}", rng.choice(["other", "agency", "code"])) for i in range(60)]
    mentions = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], schema).drop("detected_at")
    times = spark.createDataFrame([(r[1], r[2]) for r in rows], "doc_id long, t string").select("doc_id", F.to_timestamp("t").alias("detected_at"))
    mentions = mentions.join(times, "doc_id")
    whole = sorted(map(str, I.entity_parts(mentions).collect()))
    a, b, c = (I.entity_parts(mentions.where(F.col("doc_id") % 3 == i)) for i in range(3))
    assert sorted(map(str, I.merge_entities(I.merge_entities(c, a), b).collect())) == whole


def test_indexed_events_add_nothing_again(spark, tmp_path):
    entities, links = I.stores(spark, str(tmp_path), 4)
    schema = "event_id string, doc_id long, detected_at timestamp, affected_entities array<string>"
    events = spark.createDataFrame([("e1", 1, None, ["FCA", "GDPR", "fca"]), ("e2", 2, None, ["GDPR"]), ("e3", 3, None, []), ("e4", 4, None, None)], schema)
    first = {r.event_id: (r.status, r.indexed) for r in I.index_events(entities, links, 0, events.where("doc_id <> 2")).collect()}
    assert first == {"e1": ("indexed", 2), "e3": ("empty", 0), "e4": ("empty", 0)}
    again = {r.event_id: r.indexed for r in I.index_events(entities, links, 1, events).collect()}
    assert again == {"e1": 0, "e2": 1, "e3": 0, "e4": 0}
    assert sorted(r.mention_count for r in I.entity_table(entities, 1).collect()) == [2, 2]
    assert links.state(1).count() == 3


def test_passing_tables_go(spark):
    import os

    from regdelta.storage import cut, passing_tables

    kept = cut(spark.range(3), "kept")
    with passing_tables(spark):
        gone = cut(spark.range(3), "gone")
        path = gone.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3
