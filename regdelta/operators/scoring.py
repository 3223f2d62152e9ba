"""Model responses: prompts, validation, scored events, entities and obligations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regdelta import constants as C
from regdelta.functions import entity as E
from regdelta.functions import text as X
from regdelta.operators.changes import first_by, since

SCORE_JSON = (
    "significance_score string, change_type string, topic string, affected_entities array<string>, origin_countries array<string>, "
    "trade_flow_direction string, compliance_summary string, trigger_quote string, deadline_changes array<struct<old:string,new:string,deadline_text:string>>"
)
OBLIGATION_JSON = (
    "obligations array<struct<actor:string,action:string,condition:string,deadline_text:string,penalty:string,obligation_type:string,source_quote:string>>"
)
SCORED = ("significance_score", "change_type", "topic", "affected_entities", "origins", "flow", "summary", "quote", "deadlines", "error")


def first_wins(items: Column, most: int = 20) -> Column:
    """Trimmed, without empties and case-insensitive repeats, in first-seen order."""
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    lows = F.transform(trimmed, lambda x: F.lower(x))
    # the second argument of the lambda is the place from 0
    kept = F.filter(F.transform(trimmed, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(lows, F.lower(s["x"])) == s["i"] + 1)
    return F.slice(F.transform(kept, lambda s: s["x"]), 1, most)


def parse_score(body: Column) -> Column:
    """struct of the validated response; error is null or parse_error, and then all else is null."""
    r = F.from_json(body, SCORE_JSON)
    score = r["significance_score"].try_cast("double")
    flow = F.lower(F.trim(r["trade_flow_direction"]))
    deadlines = F.coalesce(r["deadline_changes"], F.array().cast("array<struct<old:string,new:string,deadline_text:string>>"))
    good = (
        score.between(0, 1)
        & r["change_type"].isin(*C.CHANGE_TYPES)
        & F.length(r["compliance_summary"]).between(1, 2000)
        & (F.coalesce(F.length(r["trigger_quote"]), F.lit(0)) <= 2000)
        & F.forall(deadlines, lambda d: d["deadline_text"].isNotNull())
    )
    ok = F.coalesce(good, F.lit(False))
    pick = lambda c: F.when(ok, c)
    none = F.array().cast("array<string>")
    return F.struct(
        pick(score).alias("significance_score"),
        pick(r["change_type"]).alias("change_type"),
        pick(F.when(r["topic"].isin(*C.TOPICS), r["topic"]).otherwise("other")).alias("topic"),
        pick(first_wins(F.coalesce(r["affected_entities"], none))).alias("affected_entities"),
        pick(E.normalize_countries(F.coalesce(r["origin_countries"], none))).alias("origins"),
        pick(F.when(flow.isin(*C.TRADE_FLOWS), flow)).alias("flow"),
        pick(r["compliance_summary"]).alias("summary"),
        pick(F.nullif(X.strip(r["trigger_quote"]), F.lit(""))).alias("quote"),
        pick(F.when(F.size(deadlines) > 0, deadlines)).alias("deadlines"),
        F.when(~ok, "parse_error").alias("error"),
    )


def score_events(events: DataFrame, versions: DataFrame, responses: DataFrame) -> DataFrame:
    """Events joined with their responses: validated scores, quote span in the new version, countries, error.

    responses: (event_id, body). An event without one stays unscored. The text of a
    version is joined to the few rows that have a quote to locate.
    """
    bodies = responses.select(F.col("event_id").alias("_answered"), "body")
    answered = events.join(bodies, F.col("event_id") == F.col("_answered"), "left").drop("_answered").withColumn("p", F.when(F.col("body").isNotNull(), parse_score(F.col("body"))))
    flat = answered.select(*events.columns, *[F.col(f"p.{c}").alias(c) for c in SCORED])
    origins, destinations = E.assign_trade(E.resolve_jurisdiction(F.col("source_url")), F.col("origins"), F.col("flow"))
    flat = flat.withColumns(
        {
            "origin_countries": F.when(F.col("error").isNull() & F.col("significance_score").isNotNull(), origins),
            "destination_countries": F.when(F.col("error").isNull() & F.col("significance_score").isNotNull(), destinations),
        }
    ).drop("origins")
    quoted = flat.where("quote is not null").select("event_id", "source_url", "content_hash", "quote").join(versions.select("source_url", "content_hash", "raw_text"), ["source_url", "content_hash"])
    spans = quoted.select("event_id", X.quote_start(F.col("raw_text"), F.col("quote")).alias("span_start"), X.quote_end(F.col("raw_text"), F.col("quote")).alias("span_end"))
    return flat.join(spans.withColumnRenamed("event_id", "_quoted"), F.col("event_id") == F.col("_quoted"), "left").drop("_quoted")


def scoring_prompt(url, title, kind, added, removed, diff, content) -> Column:
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Source URL : "), url),
        F.concat(F.lit("Title      : "), F.coalesce(F.nullif(title, F.lit("")), F.lit("(unknown)"))),
        F.concat(F.lit("Change kind: "), kind),
        F.concat(F.lit("Added chars: "), added.cast("string")),
        F.concat(F.lit("Removed chars: "), removed.cast("string")),
        F.lit(""),
    )
    text = X.trim_middle(content)
    new = F.concat_ws("\n", F.lit("Document content:"), F.lit("```"), F.when(text == "", "(no content available)").otherwise(text), F.lit("```"))
    changed = F.concat_ws("\n", F.lit("Unified diff:"), F.lit("```"), X.trim_diff(diff), F.lit("```"), F.lit("Context:"), text)
    return F.concat_ws("\n", head, F.when(kind == "created", new).otherwise(changed))


def obligation_prompt(url, title, kind, score, chunk, index, total) -> Column:
    hint = F.when(total > 1, F.format_string("Document content — chunk %d of %d.", index + 1, total)).otherwise("Document content:")
    return F.concat_ws("\n", F.concat(F.lit("Source URL: "), url), F.concat(F.lit("Title: "), F.coalesce(title, F.lit("-"))), F.concat(F.lit("Diff kind: "), kind), F.concat(F.lit("Significance score: "), F.when(score.isNotNull(), F.format_string("%.2f", score)).otherwise("-")), F.lit(""), hint, chunk)


def backlog(events: DataFrame, mode: str = "default", kind: str | None = None, domain: str | None = None, recent: str | None = None, as_of: Column | None = None, limit: int = 50) -> DataFrame:
    """Events that wait for a score, newest first; recent: a span before as_of."""
    events = since(events, "detected_at", recent, as_of) if recent else events
    rows = {"default": "significance_score is null and error is null", "retry": "significance_score is null or error is not null", "force": "true"}[mode]
    out = events.where(rows)
    if kind:
        out = out.where(F.col("diff_kind") == kind)
    if domain:
        out = out.where(F.col("source_url").contains(domain))
    return out.orderBy(F.desc("detected_at"), "event_id").limit(limit)


def entity_mentions(events: DataFrame) -> DataFrame:
    """(event_id, doc_id, detected_at, pos, surface, key, display, type) of scored events."""
    spread = events.where("affected_entities is not null").select("event_id", "doc_id", "detected_at", F.posexplode("affected_entities").alias("pos", "surface"))
    return spread.withColumn("e", E.normalize_entity(F.col("surface"))).where("e is not null").select("event_id", "doc_id", "detected_at", "pos", "surface", "e.*")


def sync_entities(mentions: DataFrame) -> DataFrame:
    """One row per key: mentions, display seen first, type seen first that is not `other`, first and last seen."""
    order = F.struct("detected_at", "doc_id", "pos")
    typed = F.min_by(F.when(F.col("type") != "other", F.col("type")), F.when(F.col("type") != "other", order))
    return mentions.groupBy("key").agg(
        F.count("*").alias("mention_count"), F.min_by("display", order).alias("display_name"), F.coalesce(typed, F.lit("other")).alias("entity_type"), F.min("detected_at").alias("first_seen_at"), F.max("detected_at").alias("last_seen_at")
    )


def entity_links(mentions: DataFrame) -> DataFrame:
    """One row per (event, entity) with the first mention's text."""
    return first_by(mentions, ["event_id", "key"], ["pos"]).select("event_id", "key", F.left("surface", F.lit(255)).alias("mention_text"))


def top_entities(
    entities: DataFrame, links: DataFrame, events: DataFrame, min_score: float | None = None, kind: str | None = None, recent: str | None = None, as_of: Column | None = None, limit: int = 15
) -> DataFrame:
    if recent:
        events = since(events, "detected_at", recent, as_of)
    e = events.select("event_id", "significance_score")
    if min_score is not None:
        e = e.where(F.col("significance_score") >= min_score)
    named = entities.select("key", "display_name", "entity_type")
    if kind:
        named = named.where(F.col("entity_type") == kind)
    out = links.join(e, "event_id").groupBy("key").agg(F.count("*").alias("mentions")).join(named, "key")
    return out.orderBy(F.desc("mentions"), "display_name", "key").limit(limit)


def unindexed_events(events: DataFrame, links: DataFrame) -> DataFrame:
    ready = events.where("significance_score is not null and size(affected_entities) > 0")
    return ready.join(links.select("event_id"), "event_id", "left_anti")


def retype_entities(entities: DataFrame) -> DataFrame:
    """Rows typed `other` whose display name gives another type now."""
    now = E.infer_entity_type(F.col("display_name"))
    return entities.where("entity_type = 'other'").withColumn("new_type", now).where("new_type <> 'other'")


def parse_obligations(chunks: DataFrame) -> DataFrame:
    """Adds items (validated obligations, null if the chunk is not usable) and parse_error."""
    df = chunks.withColumn("_o", F.from_json("body", OBLIGATION_JSON)["obligations"])
    size = lambda c, low, high: F.coalesce(F.length(c), F.lit(0)).between(low, high)
    valid = F.forall(
        "_o",
        lambda o: size(o["actor"], 1, 255) & size(o["action"], 1, 2000) & size(o["condition"], 0, 2000) & size(o["deadline_text"], 0, 255) & size(o["penalty"], 0, 2000) & size(o["source_quote"], 0, 2000),
    )
    ok = F.coalesce(F.col("_o").isNotNull() & valid, F.lit(False))
    typed = F.transform("_o", lambda o: o.withField("obligation_type", F.when(o["obligation_type"].isin(*C.OBLIGATION_TYPES), o["obligation_type"]).otherwise("other")))
    return df.withColumn("items", F.when(ok, typed)).withColumn("parse_error", ~ok).drop("_o")


def dedupe_obligations(items: DataFrame) -> DataFrame:
    """First obligation of each (event, actor, action, type), by chunk and place; keys without case and extra blanks."""
    keyed = items.withColumn("_a", X.obligation_key(F.col("actor"))).withColumn("_b", X.obligation_key(F.col("action")))
    return first_by(keyed, ["event_id", "_a", "_b", "obligation_type"], ["chunk_no", "pos"]).drop("_a", "_b")


def extraction_status(events: DataFrame, gate: float = C.Config.score_gate) -> Column:
    return F.when(F.coalesce(F.col("significance_score") < gate, F.lit(True)), "below_gate")


def extract_obligations(events: DataFrame, responses: DataFrame, gate: float = C.Config.score_gate, chunks: int = C.Config.obligation_chunks) -> tuple[DataFrame, DataFrame]:
    """(obligations, statuses). responses: (event_id, chunk_no, http_ok, body).

    A failed call on any chunk leaves the event without rows; a chunk that cannot be
    parsed loses only itself.
    """
    due = events.select("event_id", "significance_score")
    answered = responses.where(F.col("chunk_no") < chunks)
    parsed = parse_obligations(answered.join(due.where(F.col("significance_score") >= gate).select("event_id"), "event_id", "left_semi"))
    failed = parsed.where("not http_ok").select("event_id").distinct()
    usable = parsed.join(failed, "event_id", "left_anti")
    items = usable.select("event_id", "chunk_no", F.posexplode("items").alias("pos", "o")).select("event_id", "chunk_no", "pos", "o.*")
    kept = dedupe_obligations(items).withColumn("deadline_date", X.parse_deadline(F.col("deadline_text")))
    tally = usable.groupBy("event_id").agg(F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("found"), F.count_if("parse_error").alias("parse_errors"))
    kept_n = kept.groupBy("event_id").agg(F.count("*").alias("obligations"))
    status = (
        due.join(failed.withColumn("_failed", F.lit(True)), "event_id", "left").join(tally, "event_id", "left").join(kept_n, "event_id", "left")
    )
    n = F.coalesce("obligations", F.lit(0))
    said = (
        F.when(F.coalesce(F.col("significance_score") < gate, F.lit(True)), "below_gate")
        .when(F.col("_failed"), "http_error")
        .when(F.col("found").isNull(), "empty_content")
        .when(n > 0, "extracted")
        .otherwise("no_obligations")
    )
    return kept, status.select("event_id", said.alias("status"), n.alias("obligations"), (F.coalesce("found", F.lit(0)) - n).alias("duplicates_removed"), F.coalesce("parse_errors", F.lit(0)).alias("parse_errors"))


def replace_obligations(obligations: DataFrame, fresh: DataFrame) -> DataFrame:
    """Forced re-extraction: the events of fresh lose their old rows."""
    return obligations.join(fresh.select("event_id").distinct(), "event_id", "left_anti").unionByName(fresh)


def pending_obligations(events: DataFrame, gate: float = C.Config.score_gate) -> DataFrame:
    return events.where((F.col("significance_score") >= gate) & F.col("obligations_extracted_at").isNull())


def reset_scores(events: DataFrame, selected: DataFrame) -> DataFrame:
    """Score columns of the selected events set to null."""
    flag = events.join(selected.select("event_id").distinct().withColumn("_reset", F.lit(True)), "event_id", "left")
    columns = [c for c in (*SCORED, "origin_countries", "destination_countries", "span_start", "span_end") if c in events.columns]
    return flag.withColumns({c: F.when(F.col("_reset").isNull(), F.col(c)) for c in columns}).drop("_reset")




def event_text(events: DataFrame, versions: DataFrame, mode: str = "match") -> DataFrame:
    """(event_id, title, text): the new version's text; without one, summary and diff (match), or the diff, else the summary (obligations)."""
    v = versions.select("source_url", "content_hash", "title", "raw_text")
    df = events.join(v, ["source_url", "content_hash"], "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    both = F.nullif(F.concat_ws("\n", given("summary"), given("unified_diff")), F.lit(""))
    spare = both if mode == "match" else F.coalesce(given("unified_diff"), given("summary"))
    return df.select("event_id", "title", F.coalesce(given("raw_text"), spare).alias("text"))


def event_versions(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Events with the lengths and times of their new and previous versions; a created event has no previous one."""
    v = versions.select("source_url", "content_hash", F.length("raw_text").alias("chars"), "first_seen_at")
    new = v.withColumnsRenamed({"chars": "new_chars", "first_seen_at": "new_seen_at"})
    old = v.withColumnsRenamed({"content_hash": "prev_hash", "chars": "prev_chars", "first_seen_at": "prev_seen_at"})
    return events.join(new, ["source_url", "content_hash"], "left").join(old, ["source_url", "prev_hash"], "left")
