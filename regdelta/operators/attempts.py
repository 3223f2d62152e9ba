"""The life cycle of model calls: logs of attempts folded to what is known, dead or due again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regdelta import constants as C
from regdelta.functions.entity import retry_at
from regdelta.operators.scoring import extract_obligations, parse_score

def fold_attempts(events: DataFrame, attempts: DataFrame, retry_errors: bool = False, retries: int = 3) -> DataFrame:
    """One row an event: event_id, status, error, body, scored_at, calls, next_attempt_at.

    events: (event_id); attempts: (event_id, call_no, called_at, http_ok, error, body), each event's in the order of call_no. The first answer decides: a
    valid one is `scored`, one that cannot be read is `dead` with parse_error, and calls after it do not count. With
    retry_errors such an answer is not the end, a later valid one decides. Calls that failed are `retry`, due at next_attempt_at,
    until there are more than `retries` repeats: then `failed`. Events without a call are `unscored`, those of attempts that are not in events
    `missing`. scored_at is the time of the deciding or else the last call, also where it failed. All is folded by aggregates, so any
    number of attempts of one event is combined before it moves.
    """
    good = F.col("http_ok") & F.coalesce(parse_score(F.col("body"))["error"].isNull(), F.lit(False))
    judged = attempts.select("event_id", "call_no", "called_at", "http_ok", "body", F.when(~F.col("http_ok"), F.concat(F.lit("http_error: "), F.coalesce("error", F.lit("")))).when(~good, "parse_error").alias("error"))
    final = F.col("error").isNull() | (F.col("http_ok") & F.lit(not retry_errors))
    call = F.struct("call_no", "called_at", "error", "body", "http_ok")
    first = judged.where(final).groupBy("event_id").agg(F.min_by(call, "call_no").alias("d"))
    before = judged.join(first.select("event_id", F.col("d.call_no").alias("_end")), "event_id", "left").where("_end is null or call_no <= _end")
    told = before.groupBy("event_id").agg(F.count("*").alias("calls"), F.max_by(call, "call_no").alias("last"))
    rows = events.select("event_id", F.lit(True).alias("_known")).join(told, "event_id", "full")
    error, again = F.col("last.error"), ~F.col("last.http_ok")
    status = (
        F.when(F.col("_known").isNull(), "missing")
        .when(F.col("calls").isNull(), "unscored")
        .when(error.isNull(), "scored")
        .when(again & (F.col("calls") > retries), "failed")
        .when(again, "retry")
        .otherwise("dead")
    )
    out = rows.withColumn("status", status)
    due = F.when(F.col("status") == "retry", retry_at(F.col("last.called_at"), F.col("calls") - 1, C.RETRY_BASES["score"], retries + 1))
    return out.select(
        "event_id", "status", error.alias("error"), F.when(F.col("status") == "scored", F.col("last.body")).alias("body"), F.col("last.called_at").alias("scored_at"),
        F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), due.alias("next_attempt_at"),
    )


def obligation_job(requests: DataFrame, events: DataFrame, texts: DataFrame, responses: DataFrame, now: Column, gate: float = C.Config.score_gate) -> tuple[DataFrame, DataFrame]:
    """(obligations, statuses) of a list of requests.

    requests: (event_id, force); events: with significance_score and obligations_extracted_at; texts: (event_id, text); responses as of
    `extract_obligations`. statuses: event_id, status, obligations, extracted_at. In this order: missing; already_extracted, unless
    forced; below_gate; empty_content; http_error, where any chunk's call failed: nothing is kept and the event stays due;
    unanswered, where no call was made yet; extracted or no_obligations. An event requested more than once is forced if one request is.
    """
    wanted = requests.groupBy("event_id").agg(F.max("force").alias("force"))
    known = events.select("event_id", "significance_score", F.col("obligations_extracted_at").alias("_before"), F.lit(True).alias("_known"))
    rows = wanted.join(known, "event_id", "left").join(texts.select("event_id", (F.coalesce("text", F.lit("")) != "").alias("_text")), "event_id", "left")
    shut = (
        F.when(F.col("_known").isNull(), "missing")
        .when(F.col("_before").isNotNull() & ~F.col("force"), "already_extracted")
        .when(F.coalesce(F.col("significance_score") < gate, F.lit(True)), "below_gate")
        .when(~F.coalesce("_text", F.lit(False)), "empty_content")
    )
    rows = rows.withColumn("_shut", shut)
    live = events.join(rows.where("_shut is null").select("event_id"), "event_id", "left_semi")
    kept, said = extract_obligations(live, responses, gate)
    said = said.select("event_id", F.when(F.col("status") == "empty_content", "unanswered").otherwise(F.col("status")).alias("_said"), "obligations")
    out = rows.join(said, "event_id", "left").withColumn("status", F.coalesce("_shut", "_said"))
    done = F.col("status").isin("below_gate", "empty_content", "extracted", "no_obligations")
    return kept, out.select("event_id", "status", F.coalesce("obligations", F.lit(0)).cast("long").alias("obligations"), F.when(done, now).otherwise(F.col("_before")).alias("extracted_at"))
