import json
import os

import pytest
from pyspark.sql import functions as F

from regdelta.sources import channels as H
from regdelta.sources import landing as Land


def test_a_killed_task_sends_nothing_twice(spark, tmp_path):
    spool, folder = tmp_path / "spool", str(tmp_path / "outbox")
    spool.mkdir()
    rows = [(f"a{i}", 1, "email", "x@y", {4: "dies", 6: "refused"}.get(i, "s"), str(spool)) for i in range(9)] + [("b", 1, "fax", "x", "s", str(spool))]
    spark.createDataFrame(rows, "alert_id string, attempt int, channel string, recipient string, subject string, body string").coalesce(1).write.parquet(str(tmp_path / "plan"))
    plan = spark.read.parquet(str(tmp_path / "plan"))
    with pytest.raises(Exception):
        H.deliver(plan, folder, "first", "tests.senders:SENDERS").count()
    assert not os.path.exists(f"{folder}/done-first")
    for _ in range(2):  # run again, and once more
        got = {r.alert_id: (r.outcome, r.error) for r in H.deliver(plan, folder, "first", "tests.senders:SENDERS").collect()}
        assert got.pop("a4")[0] == "uncertain" and got.pop("a6") == ("failed", "mailbox full") and got.pop("b")[0] == "unroutable"
        assert set(got.values()) == {("sent", None)} and len(got) == 7
    sent = {p.name: p.read_text() for p in spool.iterdir() if p.name != "died"}
    assert sent == {f"a{i}": "x" for i in range(9) if i != 6}
    assert json.loads((tmp_path / "outbox" / "done-first").read_text()) == {"sent": 7, "uncertain": 1, "failed": 1, "unroutable": 1}


def test_settled_alerts(spark):
    alerts = spark.createDataFrame([("a", 0), ("b", 1), ("c", 4), ("d", 2), ("e", 0)], "alert_id string, delivery_attempts int").withColumns({"delivered_at": F.lit(None).cast("timestamp"), "delivery_error": F.lit(None).cast("string")})
    results = spark.createDataFrame([("a", 1, "sent", None), ("b", 2, "failed", "full"), ("c", 5, "failed", "full"), ("d", 3, "uncertain", "died")], H.RESULT)
    out = H.settle(alerts, results, F.timestamp_seconds(F.lit(1000)))
    got = {r.alert_id: (r.d, r.delivery_error, r.delivery_attempts, r.n) for r in out.withColumns({"d": F.unix_timestamp("delivered_at"), "n": F.unix_timestamp("next_attempt_at")}).collect()}
    assert got == {"a": (1000, None, 1, None), "b": (None, "full", 2, 1060), "c": (None, "full", 5, None), "d": (None, "died", 3, None), "e": (None, None, 0, None)}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for name, n in (("a.txt", 700), ("b.txt", 3)):
            (tmp_path / name).write_text("\n".join(f"{name} {i}" if i % 5 else "" for i in range(1, n + 1)) + "\n")
        lines = Land.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = lines.collect()
        assert len(got) == 703 and all(r.value == (f"{r.file.rpartition('/')[2]} {r.line}" if r.line % 5 else "") for r in got)
        entries = ['{"id": "g"}'] * 300
        entries[250] = "{broken"
        (tmp_path / "golden").mkdir()
        (tmp_path / "golden" / "g.jsonl").write_text("# all\n" + "\n".join(entries))
        with pytest.raises(Exception, match="g.jsonl, line 252"):
            Land.read_golden(spark, str(tmp_path / "golden")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
