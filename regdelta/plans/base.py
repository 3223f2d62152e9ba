"""Tables that many queries start from, in Spark and as common table expressions of DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta import constants as C
from regdelta.operators import changes, scoring
from regdelta.plans import derived as D
from regdelta.storage import cut


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case_map(expr: str, values: dict) -> str:
    return f"(CASE {expr} " + " ".join(f"WHEN {quoted([k])} THEN {quoted([v])}" for k, v in values.items()) + " END)"


def detected(spark: SparkSession, sf: str) -> DataFrame:
    return changes.detect_changes(D.observations(spark, sf))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return changes.plain_events(detected(spark, sf))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return changes.version_history(D.observations(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored events as a table of their own: matching, delivery and reports read it, often more than once."""
    e = cut(events(spark, sf), "events")
    out = scoring.score_events(e, versions(spark, sf), D.derived(spark, "responses", events=e))
    return cut(out.withColumn("scored_at", F.timestamp_seconds(F.unix_timestamp("detected_at") + 60 * (F.col("doc_id") % 50))), "scored")


OBS = f"obs AS ({D.duck_sql('observations')})"
DETECTED = f"""{OBS},
seen_obs AS (
  SELECT *, lag(content_hash) OVER t AS prev_hash, row_number() OVER (PARTITION BY source_url, content_hash ORDER BY batch, seq) AS seen
  FROM obs WINDOW t AS (PARTITION BY source_url ORDER BY batch, seq)),
detected AS (
  SELECT *, CASE WHEN seen > 1 THEN 'unchanged' WHEN prev_hash IS NULL THEN 'created' ELSE 'modified' END AS outcome,
         sha256(source_url || '|' || content_hash) AS event_id
  FROM seen_obs)"""
EVENTS = f"""{DETECTED},
change_events AS (
  SELECT event_id, source_url, content_hash, prev_hash, outcome AS diff_kind, fetched_at AS detected_at, doc_id, batch
  FROM detected WHERE outcome <> 'unchanged')"""
VERSIONS = """versions AS (
  SELECT source_url, content_hash, arg_min(source_type, batch * 100000000 + seq) AS source_type, min(fetched_at) AS first_seen_at, max(fetched_at) AS last_seen_at
  FROM obs GROUP BY source_url, content_hash)"""
_HOST = "regexp_extract(lower(source_url), '^[a-z]+://([^/?#:]*)', 1)"
_COUNTRY = f"coalesce({case_map('lower(trim(x))', C.COUNTRIES)}, CASE WHEN upper(trim(x)) = 'UK' THEN 'GB' WHEN regexp_matches(upper(trim(x)), '^[A-Z]{{2}}$') THEN upper(trim(x)) END)"


def ordered_distinct(items: str) -> str:
    """First-seen order is kept."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


SCORED = f"""{EVENTS},
responses AS ({D.duck_sql("responses")}),
raw_scores AS (
  SELECT e.*, CASE WHEN json_valid(body) THEN body END AS j FROM change_events e JOIN responses r USING (event_id)),
fields AS (
  SELECT *, try_cast(json_extract_string(j, '$.significance_score') AS DOUBLE) AS s, json_extract_string(j, '$.change_type') AS ct,
         json_extract_string(j, '$.topic') AS tp, lower(trim(json_extract_string(j, '$.trade_flow_direction'))) AS fl,
         json_extract_string(j, '$.compliance_summary') AS sm, json_extract_string(j, '$.trigger_quote') AS qt,
         list_transform(json_extract_string(j, '$.affected_entities[*]'), lambda x: trim(x)) AS en,
         list_filter(list_transform(json_extract_string(j, '$.origin_countries[*]'), lambda x: {_COUNTRY}), lambda x: x IS NOT NULL) AS oc,
         {_HOST} AS host
  FROM raw_scores),
checked AS (
  SELECT *, coalesce(s BETWEEN 0 AND 1 AND ct IN ({quoted(C.CHANGE_TYPES)}) AND length(sm) BETWEEN 1 AND 2000, false) AS good,
         list_transform(en, lambda x: lower(x)) AS low,
         (SELECT arg_max(code, length(suffix)) FROM (VALUES {", ".join(f"({quoted([k])}, {quoted([v])})" for k, v in C.JURISDICTIONS.items())}) m(suffix, code)
           WHERE host = suffix OR ends_with(host, '.' || suffix)) AS jurisdiction
  FROM fields),
placed AS (
  SELECT *, CASE WHEN fl IN ({quoted(C.TRADE_FLOWS)}) THEN fl END AS flow_ok, {ordered_distinct("oc")} AS oo,
         CASE WHEN jurisdiction IS NULL THEN [] ELSE [jurisdiction] END AS jj FROM checked),
scored AS (
  SELECT event_id, source_url, content_hash, prev_hash, diff_kind, detected_at, doc_id, batch,
         CASE WHEN good THEN s END AS significance_score, CASE WHEN good THEN ct END AS change_type,
         CASE WHEN good THEN CASE WHEN tp IN ({quoted(C.TOPICS)}) THEN tp ELSE 'other' END END AS topic,
         CASE WHEN good THEN list_filter(en, lambda x, i: list_position(low, lower(x)) = i) END AS affected_entities,
         CASE WHEN good THEN flow_ok END AS flow, CASE WHEN good THEN sm END AS summary,
         CASE WHEN good THEN nullif(trim(qt), '') END AS quote, CASE WHEN NOT good THEN 'parse_error' END AS error,
         CASE WHEN good THEN CASE flow_ok WHEN 'outbound' THEN jj WHEN 'bilateral' THEN {ordered_distinct("list_concat(jj, oo)")} ELSE oo END END AS origin_countries,
         CASE WHEN good THEN CASE flow_ok WHEN 'outbound' THEN oo WHEN 'bilateral' THEN {ordered_distinct("list_concat(jj, oo)")} ELSE jj END END AS destination_countries,
         detected_at + 60 * (doc_id % 50) AS scored_at
  FROM placed)"""
