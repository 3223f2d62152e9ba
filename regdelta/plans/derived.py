"""Tables of the domain, derived from the given ones by arithmetic.

Each is one SELECT that both Spark and DuckDB can run: these are inputs of the
operators and of the SQL that checks them, not operators. Times are kept as epoch seconds in
SQL; Spark's tables carry timestamps.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOSTS = ("www.cbp.gov", "www.fca.org.uk", "eur-lex.europa.eu", "www.customs.gov.cn", "www.federalregister.gov", "finma.ch", "www.canada.ca", "example.com")
SUFFIXES = (
    "",
    " See § 12 of the code.",
    " The importer shall comply and must pay the penalty under this section.",
    " It covers HTS 9401.61.4010 and 0304.29.00 and HScode3814.00.",
    " File by 30 June 2026",
    " File by 30 February 2026",
    " File by 2026-06-30",
)
TOPICS = ("customs_trade", "financial_services", "data_privacy", "environmental", "healthcare_pharma", "sanctions_export_control", "labor_employment", "tax_accounting", "consumer_protection", "corporate_governance", "other")
START = 1704067200  # 2024-01-01
ENTITIES = ("FCA", "Financial Conduct Authority", "sec", "U.S. Customs and Border Protection", "HTS 9401.61", "GDPR", "steel importers", "Green Program", "Acme Ltd", "acme  ltd")
NAMES = ("China", "united states", "UK", "de", "Atlantis", "European Union", "Viet Nam", "japan")


def pick(expr: str, values) -> str:
    quoted = ["'" + str(v).replace("'", "''") + "'" if v is not None else "NULL" for v in values]
    return f"(CASE {expr} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END)"


def div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


U = div("doc_id", 4)
TEMPLATES = {
    "observations": f"""
        SELECT b AS batch, doc_id AS seq, doc_id,
               'https://' || {pick("u % 8", HOSTS)} || '/doc/' || CAST(u AS STRING) AS source_url,
               {pick("u % 5", ("web", "pdf", "rss", "xml", "email"))} AS source_type,
               CASE WHEN u % 23 = 0 THEN 'Access Denied' ELSE 'Doc ' || CAST(u AS STRING) END AS title,
               body AS raw_text, lang AS language, SHA[body] AS content_hash,
               CASE WHEN doc_id % 2 = 0 THEN 'artifacts/old/' || CAST(doc_id AS STRING) END AS artifact_uri,
               CAST({START} + 86400 * b AS BIGINT) AS fetched_at
        FROM (SELECT b, doc_id, lang, u, text || {pick("doc_id % 7", SUFFIXES)} AS body
              FROM (SELECT doc_id, lang, text, {U} AS u, EXPLODE[b] FROM documents) d
              WHERE doc_id % 4 = b OR (b > 0 AND (u + b) % 3 = 0 AND doc_id % 4 = b - 1)) o
    """,
    "responses": f"""
        SELECT event_id,
               CASE WHEN doc_id % 17 = 0 THEN '{{"significance_score": 0.5, ' ELSE
               '{{"significance_score": ' || CASE WHEN doc_id % 31 = 0 THEN '"' || score || '"' WHEN doc_id % 29 = 0 THEN '1.2' ELSE score END ||
               ', "change_type": "' || CASE WHEN doc_id % 19 = 0 THEN 'rewrite' ELSE {pick("least(4, CAST(floor(((doc_id * 37) % 101) / 20) AS INT))", ("typo_or_cosmetic", "minor_wording", "clarification", "substantive", "critical"))} END ||
               '", "topic": "' || CASE WHEN doc_id % 13 = 0 THEN 'invented' ELSE {pick("doc_id % 11", TOPICS)} END ||
               '", "affected_entities": ["' || {pick("doc_id % 10", ENTITIES)} || '", " ' || {pick("(doc_id + 3) % 10", ENTITIES)} || ' ", "' || {pick("(doc_id + 1) % 10", ENTITIES)} || '"]' ||
               ', "origin_countries": ["' || {pick("doc_id % 8", NAMES)} || '", "' || {pick("(doc_id * 3) % 8", NAMES)} || '"]' ||
               ', "trade_flow_direction": ' || {pick("doc_id % 6", ('"inbound"', '" Outbound"', '"bilateral"', '"global"', '"diagonal"', "null"))} ||
               ', "compliance_summary": "Summary of ' || CAST(doc_id AS STRING) || '"' ||
               ', "trigger_quote": "' || CASE doc_id % 14 WHEN 2 THEN 'importer shall comply and must pay' WHEN 9 THEN 'importer  shall comply and  must pay' ELSE 'Quote number ' || CAST(doc_id AS STRING) || ' of the text' END || '"}}' END AS body
        FROM (SELECT *, CAST(((doc_id * 37) % 101) / 100.0 AS STRING) AS score_raw, '0.' || lpad(CAST(least((doc_id * 37) % 101, 99) AS STRING), 2, '0') AS score FROM events) e
    """,
    "golden": f"""
        SELECT 'g' || CAST(doc_id AS STRING) AS id, doc_id, CAST((doc_id % 5) / 5.0 AS DOUBLE) AS g_min, CAST((doc_id % 5) / 5.0 + 0.35 AS DOUBLE) AS g_max,
               {pick("doc_id % 5", ("typo_or_cosmetic", "minor_wording", "clarification", "substantive", "critical"))} AS g_change_type, {pick("doc_id % 11", TOPICS)} AS g_topic,
               CASE WHEN doc_id % 4 = 0 THEN 'cn' END AS g_origin, CASE WHEN doc_id % 5 = 0 THEN 'inbound' END AS g_flow, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS g_gate
        FROM documents
    """,
    "chunk_responses": """
        SELECT event_id, doc_id, c AS chunk_no, doc_id % 41 <> 0 AS http_ok,
               CASE WHEN (doc_id + c) % 11 = 0 THEN '{broken' ELSE
               '{"obligations": [{"actor": "' || CASE WHEN c % 2 = 0 THEN 'Importers of steel' ELSE '  importers  OF steel' END || '", "action": "File form ' || CAST(doc_id % 3 AS STRING) ||
               '", "deadline_text": "' || CASE doc_id % 4 WHEN 0 THEN 'by 30 June 2026' WHEN 1 THEN '2026-02-30' WHEN 2 THEN 'on March 5, 2027' ELSE 'soon' END ||
               '", "obligation_type": "' || CASE WHEN doc_id % 5 = 0 THEN 'filing' ELSE 'reporting' END || '"}, {"actor": "Banks", "action": "Report ' || CAST(c AS STRING) || '", "penalty": "fine", "obligation_type": "penalty"}]}' END AS body
        FROM (SELECT event_id, doc_id, EXPLODE[c] FROM events) e
        WHERE c <= doc_id % 4
    """,
    "attempts": """
        SELECT e.event_id, e.doc_id, c AS call_no, e.detected_at + 60 * c AS called_at, (e.doc_id * 5 + c) % 3 <> 0 AS http_ok,
               CASE WHEN (e.doc_id * 5 + c) % 3 = 0 THEN 'timeout' END AS error, CASE WHEN (e.doc_id + c) % 5 = 0 THEN '{broken' ELSE r.body END AS body
        FROM responses r JOIN (SELECT event_id, doc_id, detected_at, EXPLODE[c] FROM events) e ON r.event_id = e.event_id
        WHERE c <= e.doc_id % 4 AND e.doc_id % 9 <> 0
    """,
    "subscriptions": f"""
        SELECT c_custkey AS id, lower(c_name) || '@example.com' AS user_email, c_mktsegment AS label,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ARRAY[{pick("c_custkey % 11", TOPICS)}, {pick("(c_custkey + 4) % 11", TOPICS)}] END AS topics,
               CASE WHEN c_custkey % 3 <> 0 THEN NULL ELSE ARRAY[{pick("c_nationkey % 4", ("CN", "US", "GB", "DE"))}, 'JP'] END AS origins,
               CASE WHEN c_custkey % 4 <> 0 THEN NULL ELSE ARRAY[{pick("c_nationkey % 4", ("US", "EU", "GB", "CN"))}] END AS destinations,
               CAST((c_custkey % 10) / 10.0 AS DOUBLE) AS min_significance,
               {pick("c_custkey % 9", (None, "que & para", "der | und", "penalties & !para", "pen:*", "lithium &", "(pay <-> the <-> penalties) & importer", "the | of", "!para & !der"))} AS keyword_query,
               {pick("c_custkey % 5", ("email", "none", "slack", "webhook", "fax"))} AS channel,
               CASE WHEN c_custkey % 7 = 0 THEN 'desk@example.com' END AS channel_target,
               c_custkey % 9 <> 0 AS is_active
        FROM customer
    """,
    "calls": f"""
        SELECT SECONDS[ts] AS ts, {pick("user_id % 3", ("scoring", "obligations", "web_extract"))} AS scope_raw,
               CASE WHEN event_id % 97 <> 0 THEN {pick("user_id % 3", ("scoring", "obligations", "web_extract"))} END AS scope,
               {pick("user_id % 4", ("gpt-4o-mini", "gpt-4o", "gpt-4.1-mini", "unlisted"))} AS model, event_id,
               CAST(floor(value * 10) AS INT) AS prompt_tokens, CAST(event_id % 300 AS INT) AS completion_tokens, CAST(event_id % 4000 AS INT) AS latency_ms,
               event_type = 'error' AS failed, {pick("user_id % 8", HOSTS)} AS domain, event_type AS reason
        FROM events_table
    """,
    "actions": """
        SELECT user_id AS alert_id, SECONDS[ts] AS ts, event_id AS seq, 'u' || CAST(event_id % 7 AS STRING) AS actor,
               CASE event_type WHEN 'view' THEN 'assign' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'comment' ELSE 'waived' END AS action,
               CASE WHEN event_id % 4 <> 0 THEN 'note ' || CAST(event_id AS STRING) END AS value
        FROM events_table
    """,
    "bench": f"""
        SELECT CAST(event_id % 2 AS INT) AS run_id, event_type AS backend, CAST(event_id % 1000 AS INT) AS elapsed_ms, CAST(event_id * 7 % 900 AS INT) AS text_len,
               'https://{HOSTS[0]}/' || CAST({div("event_id", 2)} % 500 AS STRING) AS url, SHA[CAST({div("event_id", 2)} % 97 AS STRING)] AS content_hash, event_id * 7 % 900 >= 300 AS ok
        FROM events_table
    """,
    "edges": """
        SELECT i AS src, p AS pos, CASE p WHEN 0 THEN (3 * i + 1) % n WHEN 1 THEN (5 * i + 2) % n ELSE (i + 1) % n END AS dst
        FROM (SELECT page_id AS i, n, EXPLODE[p] FROM pages, (SELECT count(*) AS n FROM pages) s) e WHERE p < 3
    """,
}


def spark_sql(name: str) -> str:
    out = re.sub(r"SHA\[(.*?)\](?= AS|,)", r"sha2(\1, 256)", TEMPLATES[name])
    out = re.sub(r"EXPLODE\[(\w+)\]", r"explode(array(0, 1, 2, 3)) AS \1", out)
    out = re.sub(r"SECONDS\[(\w+)\]", r"unix_timestamp(\1)", out)
    return re.sub(r"ARRAY\[(.*?)\] END", r"array(\1) END", out)


def duck_sql(name: str) -> str:
    out = re.sub(r"SHA\[(.*?)\](?= AS|,)", r"sha256(\1)", TEMPLATES[name])
    out = re.sub(r"EXPLODE\[(\w+)\]", r"unnest([0, 1, 2, 3]) AS \1", out)
    out = re.sub(r"SECONDS\[(\w+)\]", r"CAST(floor(epoch(\1)) AS BIGINT)", out)
    out = re.sub(r"ARRAY\[(.*?)\] END", r"[\1] END", out)
    return out.replace("AS STRING)", "AS VARCHAR)").replace("events_table", "events").replace("FROM events)", "FROM change_events)")


#: Columns that are times, per derived table.
TIMES = {"observations": ("fetched_at",), "calls": ("ts",), "actions": ("ts",)}


def derived(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """The derived table, from the given tables by their names in the template."""
    sql = spark_sql(name)
    for t in tables:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    # other braces are text of the template
    sql = re.sub(r"\{(?!(?:" + "|".join(tables) + r")\})", "{{", sql) if tables else sql
    out = spark.sql(_escape(sql, tables), **tables)
    for c in TIMES.get(name, ()):
        out = out.withColumn(c, F.timestamp_seconds(c))
    return out


def _escape(sql: str, tables) -> str:
    """Doubles the closing braces that belong to the text."""
    keep = re.compile(r"\{(" + "|".join(tables) + r")\}")
    parts, at = [], 0
    for m in keep.finditer(sql):
        parts.append(sql[at : m.start()].replace("}", "}}"))
        parts.append(m.group())
        at = m.end()
    return "".join([*parts, sql[at:].replace("}", "}}")])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evenly(rows: DataFrame) -> DataFrame:
    """A table of fewer file splits than half the cores is dealt to all of them; others, as any large one, stay as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, "observations", documents=evenly(read(spark, sf_dir, "documents").select("doc_id", "lang", "text")))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, "subscriptions", customer=read(spark, sf_dir, "customer"))


def from_events(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derived(spark, name, events_table=read(spark, sf_dir, "events"))
