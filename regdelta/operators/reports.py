"""Reports over documents, versions, events, alerts, ledgers and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdelta import constants as C
from regdelta.functions import text as X
from regdelta.functions.entity import compute_cost
from regdelta.operators.changes import since


def _of(df: DataFrame, domain: str) -> DataFrame:
    return df.where(F.col("source_url").contains(domain)) if domain else df


def report_documents(docs: DataFrame, domain: str = "") -> DataFrame:
    return _of(docs, domain).groupBy("source_type", "language").agg(F.count("*").alias("docs"), F.sum(F.length("raw_text")).alias("text_chars"), F.count_if(F.col("artifact_uri").isNotNull()).alias("archived"))


def report_versions(versions: DataFrame, as_of: Column, domain: str = "") -> DataFrame:
    recent = F.unix_timestamp("first_seen_at") > F.unix_timestamp(as_of) - 3600
    return _of(versions, domain).groupBy("source_type").agg(F.countDistinct("source_url").alias("unique_urls"), F.count("*").alias("versions_total"), F.count_if(recent).alias("versions_last_hour"))


def _mean(score: Column) -> Column:
    """To two places; summed up exactly, so that the order of the rows does not matter."""
    return F.round(F.sum(score.cast("decimal(18,6)")).cast("double") / F.count(score), 2)


def report_scoring(events: DataFrame, domain: str = "") -> DataFrame:
    s, e = F.col("significance_score"), F.col("error")
    return _of(events, domain).groupBy("diff_kind", "change_type").agg(
        F.count("*").alias("events"), F.count(s).alias("scored"), F.count(e).alias("errored"), F.count_if(s.isNull() & e.isNull()).alias("unscored"), _mean(s).alias("avg_score")
    )


def report_topics(events: DataFrame, domain: str = "") -> DataFrame:
    return _of(events, domain).groupBy(F.coalesce("topic", F.lit("(unscored)")).alias("topic")).agg(F.count("*").alias("events"), _mean(F.col("significance_score")).alias("avg_score"))


def top_scored(events: DataFrame, domain: str = "", limit: int = 10) -> DataFrame:
    rows = _of(events, domain).where("significance_score is not null").orderBy(F.desc_nulls_last("significance_score"), F.desc("detected_at"), "event_id").limit(limit)
    return rows.select(
        F.date_format("detected_at", "yyyy-MM-dd HH:mm").alias("seen"), "diff_kind", F.round("significance_score", 2).alias("score"), "change_type", "topic",
        F.left(F.regexp_replace("source_url", "^https?://", ""), F.lit(60)).alias("url"), F.left(F.coalesce("summary", F.lit("(no summary)")), F.lit(90)).alias("summary"),
    )


def recent_obligations(obligations: DataFrame, limit: int = 10) -> DataFrame:
    rows = obligations.orderBy("event_id", "chunk_no", "pos").limit(limit)
    deadline = F.coalesce(F.col("deadline_date").cast("string"), F.left("deadline_text", F.lit(20)), F.lit("-"))
    return rows.select("event_id", F.col("obligation_type").alias("type"), deadline.alias("deadline"), F.left("actor", F.lit(30)).alias("actor"), F.left("action", F.lit(80)).alias("action"))


def latest_samples(docs: DataFrame, limit: int = 3) -> DataFrame:
    rows = docs.orderBy(F.desc("fetched_at"), F.desc("seq")).limit(limit)
    return rows.select("seq", "source_type", "language", F.left("title", F.lit(60)).alias("title"), F.length("raw_text").alias("chars"), F.left("raw_text", F.lit(200)).alias("preview"))


def corpus_snapshot(docs: DataFrame) -> DataFrame:
    """Documents of each source type and their share; the counts are a handful of rows when the shares are worked out."""
    counts = docs.groupBy("source_type").agg(F.count("*").alias("docs"))
    return counts.withColumn("pct", F.round(F.col("docs") * 100.0 / F.sum("docs").over(Window.partitionBy()), 1))


def list_changes(events: DataFrame, kind=None, url=None, domain=None, min_score=None, change_type=None, topic=None, recent: str | None = None, as_of: Column | None = None, limit: int = 50) -> DataFrame:
    """The newest events that fit. recent: a span before as_of, as `since` takes it."""
    out = since(events, "detected_at", recent, as_of) if recent else events
    for column, value in (("diff_kind", kind), ("source_url", url), ("change_type", change_type), ("topic", topic)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if url is None and domain:
        out = out.where(F.col("source_url").contains(domain))
    if min_score is not None:
        out = out.where(F.col("significance_score") >= min_score)
    return out.orderBy(F.desc("detected_at"), "event_id").limit(limit)


def list_obligations(obligations: DataFrame, events: DataFrame, kind: str | None = None, upcoming: bool = False, as_of: Column | None = None, recent: str | None = None, limit: int = 50) -> DataFrame:
    if recent:
        events = since(events, "detected_at", recent, as_of)
    out = obligations.join(events.select("event_id", "source_url", "detected_at"), "event_id")
    if kind:
        out = out.where(F.col("obligation_type") == kind)
    order = [F.desc("detected_at")]
    if upcoming:
        out = out.where(F.col("deadline_date") >= F.to_date(as_of))
        order.append(F.asc("deadline_date"))
    return out.orderBy(*order, "event_id", "chunk_no", "pos").limit(limit)


def with_countries(events: DataFrame, codes: list[str]) -> DataFrame:
    """Events whose origins contain all of the codes."""
    return events.where(F.size(F.array_except(F.array(*map(F.lit, codes)), F.coalesce("origin_countries", F.array().cast("array<string>")))) == 0)


def code_bearing_pdfs(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("source_url").ilike("%.pdf") & F.col("raw_text").rlike(C.CODE_PATTERNS[0][1])).select("source_url").distinct()


def mine_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, surface, pattern): each code of a document once, by the first pattern that has it."""
    spread = docs.select("doc_id", F.posexplode(X.extract_codes(F.col("raw_text"))).alias("pos", "c")).select("doc_id", "pos", "c.*")
    return spread.groupBy("doc_id", "surface").agg(F.min_by("pattern", "pos").alias("pattern"))


def top_codes(pairs: DataFrame, limit: int = 15) -> DataFrame:
    return pairs.groupBy("surface").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "surface").limit(limit)


def pattern_hits(pairs: DataFrame) -> DataFrame:
    """Codes that each pattern was the first to find, a document's codes once each."""
    return pairs.groupBy("pattern").agg(F.count("*").alias("hits"))


def code_totals(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: docs_scanned, docs_with_code, mentions (code and document) and codes."""
    found = pairs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("docs_with_code"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))
    codes = pairs.select("surface").distinct().agg(F.count("*").alias("codes"))
    return docs.agg(F.count("*").alias("docs_scanned")).join(found).join(codes)  # one row each


def verified_quotes(events: DataFrame, limit: int = 5) -> DataFrame:
    """The events scored last, with their quotes and whether these were found in the text."""
    rows = events.where("scored_at is not null and significance_score is not null").orderBy(F.desc("scored_at"), "event_id").limit(limit)
    return rows.select(F.left("source_url", F.lit(50)).alias("url"), "change_type", "topic", F.col("significance_score").alias("score"), F.left("quote", F.lit(80)).alias("quote"), F.col("span_start").isNotNull().alias("quote_verified"))


def url_category_counts(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return docs.agg(*[F.count_if(F.col("source_url").like(p)).alias(k) for k, p in patterns.items()])


def with_cost(calls: DataFrame) -> DataFrame:
    return calls.withColumn("cost", compute_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("model")))


def cost_report(calls: DataFrame, start: Column | None = None, scope: str | None = None) -> DataFrame:
    """Totals, by scope, by model and by UTC day in one pass: cut (all, scope, model, day), key and figures; of calls from start on and of one scope."""
    if start is not None:
        calls = calls.where(F.col("ts") >= start)
    if scope:
        calls = calls.where(F.col("scope") == scope)
    rows = with_cost(calls).select(
        F.coalesce("scope", F.lit("unknown")).alias("scope"), F.coalesce("model", F.lit("unknown")).alias("model"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "prompt_tokens", "completion_tokens", "cost"
    )
    sets = rows.groupingSets([[], [F.col("scope")], [F.col("model")], [F.col("day")]], "scope", "model", "day").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.avg("cost"), 6).alias("avg_cost")
    )
    cut = F.when(F.col("_g") == 7, "all").when(F.col("_g") == 3, "scope").when(F.col("_g") == 5, "model").otherwise("day")
    return sets.select(cut.alias("cut"), F.coalesce("scope", "model", "day", F.lit("")).alias("key"), "calls", "prompt", "completion", "cost", "avg_cost")


def most_expensive(calls: DataFrame, limit: int = 5) -> DataFrame:
    return with_cost(calls).orderBy(F.desc("cost"), "event_id").limit(limit).select("event_id", "model", "cost")


def cost_per_event(calls: DataFrame) -> DataFrame:
    """By class of event (scored alone, or with obligations): events, calls, tokens and mean cost."""
    per = with_cost(calls).groupBy("event_id").agg(
        F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("cost").alias("cost"), F.max((F.coalesce(F.col("scope"), F.lit("")) == "obligations").cast("int")).alias("_o")
    )
    kind = F.when(F.col("_o") == 1, "with_obligations").otherwise("scored_only")
    return per.groupBy(kind.alias("class")).agg(F.count("*").alias("events"), F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.avg("cost"), 8).alias("mean_cost"))


def pipeline_lag(events: DataFrame, as_of: Column, days: int = 7, gate: float = C.Config.score_gate) -> DataFrame:
    """Of the events detected in the days before as_of: p50 and p95 seconds from detection to score and from score to obligations,
    events without a score, and scored ones whose obligations are still to come. Equal lags are counted before percentiles are taken."""
    seconds, score = F.unix_timestamp, F.col("significance_score")
    pending = F.col("scored_at").isNotNull() & F.col("obligations_extracted_at").isNull() & F.coalesce(score >= gate, F.lit(False))
    recent = events.where(seconds("detected_at") > seconds(as_of) - days * 86_400)
    counts = recent.groupBy(
        (seconds("scored_at") - seconds("detected_at")).alias("a"), (seconds("obligations_extracted_at") - seconds("scored_at")).alias("b"), score.isNull().alias("unscored"), pending.alias("pending")
    ).agg(F.count("*").alias("n"))
    lag = lambda c, p: F.percentile(c, p, F.col("n"))
    tally = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    return counts.agg(
        lag("a", 0.5).alias("p50_score"), lag("a", 0.95).alias("p95_score"), lag("b", 0.5).alias("p50_obligations"), lag("b", 0.95).alias("p95_obligations"),
        tally("unscored").alias("unscored"), tally("pending").alias("pending"),
    )


def bench_summary(results: DataFrame) -> DataFrame:
    """By backend: totals, ok rate, percentiles at the half-even rounded index, mean length of ok texts.

    Equal times are counted first, so that a backend's rows are its distinct times when they are put in order.
    """
    ok = F.col("ok")
    per = results.groupBy("backend", "elapsed_ms").agg(
        F.count("*").alias("n"), F.count("elapsed_ms").alias("timed"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.sum("text_len").alias("chars"), F.count("text_len").alias("texts")
    )
    w = Window.partitionBy("backend")
    placed = per.withColumns({"upto": F.sum("timed").over(w.orderBy(F.asc_nulls_first("elapsed_ms"))), "all": F.sum("timed").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.rint(F.lit(p / 100) * (F.col("all") - 1)), F.col("elapsed_ms")))
    out = placed.groupBy("backend").agg(
        F.sum("n").alias("total"), F.sum("ok").alias("ok"), F.sum("errors").alias("errors"), at(50).alias("p50"), at(95).alias("p95"), F.floor(F.try_divide(F.sum("chars"), F.sum("texts"))).alias("avg_len")
    )
    return out.select("backend", "total", "ok", "errors", F.round(F.col("ok") / F.col("total"), 3).alias("ok_rate"), "p50", "p95", "avg_len")


def false_changes(results: DataFrame, run_a: int, run_b: int) -> DataFrame:
    a = results.where(F.col("run_id") == run_a).select("backend", "url", F.col("content_hash").alias("a"))
    b = results.where(F.col("run_id") == run_b).select("backend", "url", F.col("content_hash").alias("b"))
    return a.join(b, ["backend", "url"]).withColumn("changed", ~F.col("a").eqNullSafe(F.col("b")))


def eval_failures(golden: DataFrame, gate: float = C.Config.score_gate) -> DataFrame:
    """Adds failures to golden entries joined with their outcomes (columns g_* expected, others actual)."""
    score = F.col("significance_score")
    upper = lambda c: F.transform(c, lambda x: F.upper(x))
    missing = F.size(F.array_except(upper(F.col("g_origins")), upper(F.coalesce("origins", F.array().cast("array<string>"))))) > 0
    checks = F.array_compact(
        F.array(
            F.when(~score.between(F.col("g_min"), F.col("g_max")), "score"),
            F.when(F.col("change_type") != F.col("g_change_type"), "change_type"),
            F.when(F.col("topic") != F.col("g_topic"), "topic"),
            F.when(F.col("g_origins").isNotNull() & missing, "origin_countries"),
            F.when(F.col("g_flow").isNotNull() & ~F.col("flow").eqNullSafe(F.col("g_flow")), "trade_flow_direction"),
            F.when(F.col("g_gate").isNotNull() & ((score >= gate) != F.col("g_gate")), "obligations_gate"),
        )
    )
    return golden.withColumn("failures", F.when(F.col("error").isNotNull() | score.isNull(), F.array(F.lit("parse_error"))).otherwise(checks))


def eval_metrics(results: DataFrame, gate: float = C.Config.score_gate) -> DataFrame:
    n, score = F.count("*"), F.col("significance_score")
    right = F.coalesce((score >= gate) == F.col("g_gate"), F.lit(False))
    labelled = F.count_if(F.col("g_gate").isNotNull())
    rate = lambda c: F.round(F.try_divide(c, n), 6)
    latency = [F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("total_latency_ms")] if "latency_ms" in results.columns else []
    return results.agg(
        *latency,
        n.alias("n_entries"),
        rate(F.count_if(F.size("failures") == 0)).alias("pass_rate"),
        F.round(F.avg(F.abs(score - (F.col("g_min") + F.col("g_max")) / 2)), 6).alias("score_mae"),
        rate(F.count_if(F.coalesce(F.col("change_type") == F.col("g_change_type"), F.lit(False)))).alias("change_type_accuracy"),
        rate(F.count_if(F.coalesce(F.col("topic") == F.col("g_topic"), F.lit(False)))).alias("topic_accuracy"),
        F.round(F.try_divide(F.count_if(F.col("g_gate").isNotNull() & right), labelled), 6).alias("gate_accuracy"),
    )


def tariff_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("topic", F.lit("(unscored)")).alias("topic")).agg(
        F.count("*").alias("events"), F.count_if(F.size("origin_countries") > 0).alias("with_origin"), F.count_if(F.size("destination_countries") > 0).alias("with_destination"), F.count_if(F.col("flow").isNotNull()).alias("with_flow")
    )


def provenance_counts(promoted: DataFrame) -> DataFrame:
    return promoted.groupBy("provenance").agg(F.count("*").alias("documents"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(100, limit))


def page_with_total(df: DataFrame, order: list, offset: int = 0, limit: int = 20, status: str | None = None) -> DataFrame:
    """A page of the rows, of one status if it is given, each with the number of all of them."""
    rows = df.where(F.col("status") == status) if status else df
    return page(rows, order, offset, limit).join(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
