"""Composite jobs: ingest, domain report, evaluation, benchmark report, re-scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regdelta.operators import changes as G
from regdelta.operators import reports as R
from regdelta.operators import scoring as S


def ingest(docs: DataFrame, state: DataFrame | None, archived: DataFrame, now: Column, filtered: bool = True, versions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Filter, archive, upsert and change detection of a batch.

    Returns documents (the new state), archive (rows with their URI), dropped (with reasons) and changes (each row that
    was kept, with its outcome against versions, the history from before).
    """
    judged = G.content_filter(docs)
    kept = judged.where("passed").select(*docs.columns) if filtered else docs
    dropped = judged.where("not passed") if filtered else judged.where("false")
    return {"documents": G.upsert_documents(state, kept, now), "archive": G.archive_keys(kept, archived), "dropped": dropped, "changes": G.detect_changes(kept, versions)}


def ingest_stats(docs: DataFrame, archive: DataFrame, judged: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row: inserted, updated (repeats within the batch count too), archived (new texts, each once), created, modified and unchanged, filtered, and the reasons as a map."""
    a = docs.agg(
        F.count_if(F.col("outcome") == "inserted").alias("inserted"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "updated", F.col("repeats")).when(F.col("outcome") == "inserted", F.col("repeats") - 1)), F.lit(0)).alias("updated"),
    )
    b = archive.where("not reused").select("content_hash").distinct().agg(F.count("*").alias("archived"))
    reasons = judged.groupBy("reason").agg(F.count("*").alias("n"))
    c = reasons.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filtered"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    out = a.join(b).join(c)  # one row each
    return out.join(changes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("created", "modified", "unchanged")])) if changes is not None else out


def domain_report(docs, versions, events, entities, links, obligations, domain: str, as_of: Column) -> dict[str, DataFrame]:
    """The eight sections of a report on the sources whose URL contains the domain."""
    mine = events.where(F.col("source_url").contains(domain))
    recent = R.since(mine, "detected_at", "30d", as_of)
    return {
        "documents": R.report_documents(docs, domain),
        "versions": R.report_versions(versions, as_of, domain),
        "scoring": R.report_scoring(events, domain),
        "top_scored": R.top_scored(events, domain),
        "topics": R.report_topics(events, domain),
        "entities": S.top_entities(entities, links, recent),
        "obligations": R.recent_obligations(obligations.join(mine.select("event_id"), "event_id", "left_semi")),
        "samples": R.latest_samples(docs.where(F.col("source_url").contains(domain))),
    }


def run_eval(golden: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry results, one row of metrics). golden: of read_golden; responses: (id, body) and optionally error, of a call that failed, and latency_ms."""
    e = golden.select(
        "id",
        F.col("expected.significance_score.min").alias("g_min"),
        F.col("expected.significance_score.max").alias("g_max"),
        F.col("expected.change_type").alias("g_change_type"),
        F.col("expected.topic").alias("g_topic"),
        F.col("expected.origin_countries").alias("g_origins"),
        F.col("expected.trade_flow_direction").alias("g_flow"),
        F.col("expected.should_trigger_obligations").alias("g_gate"),
    )
    more = [c for c in ("latency_ms",) if c in responses.columns]
    failed = F.col("error").isNotNull() if "error" in responses.columns else F.lit(False)
    answers = responses.select("id", "body", failed.alias("_failed"), *more)
    scored = e.join(answers, "id", "left").withColumn("p", S.parse_score(F.when(~F.col("_failed"), F.col("body"))))
    results = R.eval_failures(scored.select(*e.columns, *more, "_failed", "p.*"))
    results = results.withColumn("failures", F.when(F.col("_failed"), F.array(F.lit("llm_error"))).otherwise(F.col("failures"))).drop("_failed")
    return results, R.eval_metrics(results)


def bench_report(results: DataFrame, least: int = 300) -> DataFrame:
    """Summary by backend, a result being ok if it has no error and its normal text is long enough."""
    ok = F.col("error").isNull() & (F.col("text_len") >= least)
    return R.bench_summary(results.withColumn("ok", F.coalesce(ok, F.lit(False))))


def score_with(prompts: DataFrame, responses: DataFrame | None = None, call: Callable | None = None) -> DataFrame:
    """(event_id, body) for prompts (event_id, request_hash, prompt): from a table of responses by request hash, or
    from a function over iterators of pandas frames, as mapInPandas takes it."""
    if responses is not None:
        return prompts.join(responses.select("request_hash", "body"), "request_hash", "left").select("event_id", "body")
    return prompts.mapInPandas(call, "event_id string, body string")


def rescore(events: DataFrame, selected: DataFrame, versions: DataFrame, responses: DataFrame) -> DataFrame:
    """Scores of the selected events are dropped and made anew; all other events stay as they are."""
    chosen = events.join(selected.select("event_id").distinct(), "event_id", "left_semi")
    base = [c for c in events.columns if c not in (*S.SCORED, "origin_countries", "destination_countries", "span_start", "span_end", "scored_at")]
    fresh = S.score_events(chosen.select(*base), versions, responses)
    return events.join(chosen.select("event_id"), "event_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def comments(log: DataFrame) -> DataFrame:
    """Comments of an action log, oldest first within each alert."""
    return log.where("action = 'comment'").select("alert_id", "ts", "seq", "actor", F.col("value").alias("body")).orderBy("alert_id", "ts", "seq")


def activity(log: DataFrame, limit: int = 100) -> DataFrame:
    """Newest actions first; a comment's preview has 140 characters."""
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(limit).withColumn("value", F.when(F.col("action") == "comment", F.left("value", F.lit(140))).otherwise(F.col("value")))


def ok_status(attempts: DataFrame) -> DataFrame:
    return attempts.where("status_code < 400")
