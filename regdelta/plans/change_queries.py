"""Queries: filters, urls, texts, versions, change events and their reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regdelta import constants as C
from regdelta.functions import entity as E
from regdelta.functions import text as X
from regdelta.functions import url as L
from regdelta.operators import changes as G
from regdelta.operators import jobs as J
from regdelta.operators import reports as R
from regdelta.operators.store import BucketStore
from regdelta.plans import base as B
from regdelta.plans import derived as D
from regdelta.plans.registry import query
from regdelta.storage import cut, shared_dir

DAY = 86_400
AS_OF = D.START + 4 * DAY


def _duck_list(values) -> str:
    return "[" + B.quoted(values) + "]"


_MARKER = C.MARKER_PATTERN.replace("'", "''")
FILTER_SQL = f"""WITH {B.OBS},
t AS (SELECT *, trim(CASE WHEN coalesce(title, '') <> '' THEN title || chr(10) || chr(10) ELSE '' END || raw_text) AS corpus FROM obs),
k AS (SELECT *, regexp_extract_all(lower(corpus), '{C.WORD_PATTERN}') AS tokens, regexp_extract(corpus, '{_MARKER}') AS mark FROM t),
h AS (SELECT *, len(tokens) AS word_count, len(list_distinct(list_filter(tokens, lambda x: list_contains({_duck_list(C.REGULATORY_WORDS)}, x)))) + CAST(contains(lower(corpus), 'ai sensi') AS INT) AS keyword_hits, mark <> '' AS structural FROM k),
r AS (SELECT *, CASE WHEN corpus = '' THEN 'empty' WHEN structural AND word_count >= 50 THEN 'structural_marker'
       WHEN word_count >= 50 AND keyword_hits >= 3 AND keyword_hits / word_count >= 0.02 THEN 'dense_short' WHEN word_count < 300 THEN 'too_short'
       WHEN keyword_hits < 3 THEN 'no_regulatory_keywords' WHEN keyword_hits / word_count < 0.003 THEN 'low_keyword_density' ELSE 'passed' END AS reason FROM h)
"""


@query(FILTER_SQL + "SELECT batch, seq, reason IN ('structural_marker', 'dense_short', 'passed') AS passed, reason, word_count, keyword_hits, structural, left(mark, 40) AS marker FROM r")
def content_filter(spark, sf):
    out = G.content_filter(D.observations(spark, sf))
    return out.select("batch", "seq", "passed", "reason", F.col("word_count").cast("long"), F.col("keyword_hits").cast("long"), "structural", "marker")


@query(FILTER_SQL + "SELECT batch, seq, source_url, content_hash FROM r WHERE reason IN ('structural_marker', 'dense_short', 'passed')")
def content_filter_kept(spark, sf):
    return G.apply_content_filter(D.observations(spark, sf)).select("batch", "seq", "source_url", "content_hash")


@query(FILTER_SQL + "SELECT reason, count(*) AS n FROM r GROUP BY reason")
def filter_reasons(spark, sf):
    return G.content_filter(D.observations(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {B.OBS}, p AS (SELECT *, list_filter({_duck_list(C.BLOCKER_TITLES)}, lambda x: contains(lower(title), x))[1] AS t,
  list_filter({_duck_list(C.BLOCKER_BODIES)}, lambda x: contains(lower(left(raw_text, 4000)), x))[1] AS b, length(raw_text) AS n FROM obs)
SELECT batch, seq, CASE WHEN raw_text = '' THEN NULL WHEN t IS NOT NULL THEN 'title:''' || t || '''' WHEN b IS NOT NULL AND n < 1500 THEN 'body:''' || b || '''+short(' || n || 'c)'
  WHEN length(trim(raw_text, ' ' || chr(10) || chr(9))) < 200 THEN 'empty_body(' || n || 'c)' END AS reason FROM p""")
def blocker_pages(spark, sf):
    return D.observations(spark, sf).select("batch", "seq", X.blocker_reason(F.col("raw_text"), F.col("title")).alias("reason"))


_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_NETLOC = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_REPEATED = "list_filter(range(1, 200), lambda i: s[i] <> '' AND length(s[i]) >= 2 AND s[i] = s[i + 1] AND s[i] = s[i + 2])"


@query(f"""WITH p AS (SELECT page_id, url, {_PATH} AS path, {_NETLOC} AS net, string_split({_PATH}, '/') AS s FROM pages)
SELECT page_id, length(url) > 512 OR regexp_matches(url, '{C.SESSION_PATTERN}') OR regexp_matches(path, '{C.CALENDAR_PATTERN}') OR len({_REPEATED}) > 0 AS trap,
  regexp_matches(lower(path), '({"|".join(x.replace(".", "[.]") for x in C.SKIPPED_ENDINGS)})$') OR len(list_filter({_duck_list(C.SKIPPED_FRAGMENTS)}, lambda x: contains(lower(path), x))) > 0 AS skippable,
  CASE WHEN ends_with(lower(path), '.pdf') THEN 'pdf' WHEN ends_with(lower(path), '.xml') THEN 'xml' ELSE 'html' END AS class,
  regexp_replace(net, '^[w.]+', '') = 'example.com' OR ends_with(regexp_replace(net, '^[w.]+', ''), '.example.com') AS same_domain,
  starts_with(path, '/en/') AS in_prefix, split_part(net, ':', 1) AS host,
  CASE WHEN ends_with(lower(path), '.pdf') THEN 'pdf' WHEN contains(lower(url), 'rss') OR contains(lower(url), 'atom') OR contains(lower(url), 'feed') THEN 'rss' ELSE 'web' END AS kind
FROM p""")
def url_checks(spark, sf):
    u = F.col("url")
    return D.read(spark, sf, "pages").select(
        "page_id", L.is_spider_trap(u).alias("trap"), L.is_skippable(u).alias("skippable"), L.link_class(u).alias("class"), L.is_same_domain(u, "example.com").alias("same_domain"),
        L.path_prefix(u, "/en/").alias("in_prefix"), L.host_of(u).alias("host"), L.infer_kind(u).alias("kind"),
    )


@query(f"""WITH p AS (SELECT page_id, url, {_PATH} AS path, {_NETLOC} AS net, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]*=.') AND NOT list_contains({_duck_list(C.TRACKING_PARAMS)}, lower(split_part(x, '=', 1))))) AS kept, regexp_replace(path, '/+$', '') AS bare FROM p)
SELECT page_id, lower(split_part(url, '://', 1)) || '://' || net || CASE WHEN bare = '' THEN '/' ELSE bare END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical,
  regexp_replace(regexp_replace(lower(url), '^(https://|http://)(www[.])?', ''), '/+$', '') AS domain FROM k""")
def url_canonical(spark, sf):
    u = F.col("url")
    return D.read(spark, sf, "pages").select("page_id", L.normalize_url(u).alias("canonical"), L.normalize_domain(u).alias("domain"))


@query("""WITH l AS (SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1), lambda x: trim(x)), lambda h: h <> '' AND NOT regexp_matches(h, '(?i)^(javascript:|mailto:|#)'))) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM l GROUP BY page_id, href""")
def page_links(spark, sf):
    links = D.read(spark, sf, "pages").select("page_id", F.explode(L.extract_links(F.col("html"))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"""WITH {B.OBS}, c AS (SELECT batch, seq, regexp_replace(regexp_replace(raw_text, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') AS t, raw_text FROM obs),
n AS (SELECT *, trim(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^[|*_ \\t-]*$')), ' '), '\\s+', ' ', 'g')) AS norm FROM c)
SELECT batch, seq, sha256(norm) AS norm_hash, length(norm) AS norm_len, length(trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))) AS bench_len FROM n""")
def text_hashes(spark, sf):
    norm = X.normalize_for_hash(F.col("raw_text"))
    return D.observations(spark, sf).select("batch", "seq", X.content_hash(norm).alias("norm_hash"), F.length(norm).cast("long").alias("norm_len"), F.length(X.bench_normalize(F.col("raw_text"))).cast("long").alias("bench_len"))


_VOTES = ", ".join(f"len(list_filter(words, lambda x: list_contains({_duck_list(ws)}, x))) AS {k}" for k, ws in C.FUNCTION_WORDS.items())
_BEST = f"greatest({', '.join(C.FUNCTION_WORDS)})"
_SHARE = "(length(head) - length(regexp_replace(head, '[{}]', '', 'g'))) / letters > 0.1"


@query(f"""WITH h AS (SELECT doc_id, lang, left(coalesce(text, ''), 4000) AS head FROM documents),
w AS (SELECT *, regexp_split_to_array(lower(head), '[^\\p{{L}}]+') AS words, length(regexp_replace(head, '[\\s\\p{{P}}\\p{{S}}\\p{{Z}}]', '', 'g')) AS letters FROM h),
v AS (SELECT *, {_VOTES} FROM w)
SELECT doc_id, lang, CASE WHEN letters = 0 THEN NULL WHEN {_SHARE.format("가-힯ᄀ-ᇿ㄰-㆏")} THEN 'ko' WHEN {_SHARE.format("぀-ゟ゠-ヿ")} THEN 'ja' WHEN {_SHARE.format("一-鿿㐀-䶿豈-﫿")} THEN 'zh'
  WHEN {_BEST} > 0 THEN CASE {_BEST} {" ".join(f"WHEN {k} THEN '{k}'" for k in sorted(C.FUNCTION_WORDS, reverse=True))} END END AS language FROM v""")
def detect_language(spark, sf):
    """The vote of function words; of equal votes the last language by name wins."""
    return D.read(spark, sf, "documents").select("doc_id", "lang", X.detect_language(F.col("text")).alias("language"))


@query(f"WITH {B.OBS} SELECT batch, seq, length(t) AS n, sha256(t) AS h, left(sha256('gpt-4o-mini' || chr(31) || 'system' || chr(31) || raw_text), 12) AS request_hash FROM (SELECT batch, seq, raw_text, CASE WHEN length(s) <= 6000 THEN s ELSE left(s, 4500) || chr(10) || '… [content truncated for scoring — ' || length(s) || ' chars total] …' || chr(10) || right(s, 1500) END AS t FROM (SELECT *, trim(raw_text, ' ' || chr(10) || chr(9)) AS s FROM obs))")
def trimmed_content(spark, sf):
    t = X.trim_middle(F.col("raw_text"))
    return D.observations(spark, sf).select("batch", "seq", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("h"), X.request_hash(F.lit("gpt-4o-mini"), F.lit("system"), F.col("raw_text")).alias("request_hash"))


@query(f"""WITH {B.OBS} SELECT batch, seq, i AS chunk_no, substring(raw_text, i * 5600 + 1, 6000) AS chunk FROM (SELECT batch, seq, raw_text, unnest(range(0, CAST(ceil(length(raw_text) / 5600.0) AS BIGINT))) AS i FROM obs)""")
def fixed_chunks(spark, sf):
    o = D.observations(spark, sf)
    return o.select("batch", "seq", F.posexplode(X.fixed_chunks(F.col("raw_text"), 6000, 400)).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query()
def paragraph_chunks(spark, sf):
    o = D.observations(spark, sf)
    paragraphs = F.regexp_replace("raw_text", r"\.\n", ".\n\n")
    return o.select("batch", "seq", F.posexplode(X.chunk_text(paragraphs)).alias("chunk_no", "chunk"))


@query(f"""WITH {B.OBS}, q AS (SELECT batch, seq, raw_text, trim(substring(raw_text, 11, 60), ' ' || chr(10)) AS q FROM obs)
SELECT batch, seq, CAST(CASE WHEN length(q) >= 20 THEN strpos(raw_text, q) - 1 END AS VARCHAR) AS span_start, CAST(CASE WHEN length(q) >= 20 THEN strpos(raw_text, q) - 1 + length(q) END AS VARCHAR) AS span_end FROM q""")
def quote_spans(spark, sf):
    q = F.substring("raw_text", 11, 60)
    o = D.observations(spark, sf)
    return o.select("batch", "seq", X.quote_start(F.col("raw_text"), q).cast("string").alias("span_start"), X.quote_end(F.col("raw_text"), q).cast("string").alias("span_end"))


_NAMES = "|".join(C.MONTHS)
_ISO, _DMY, _MDY = r"\b(\d{4}-\d{2}-\d{2})\b", rf"(?i)\b(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}})\b", rf"(?i)\b({_NAMES})\s+(\d{{1,2}}),\s*(\d{{4}})\b"


@query(f"""WITH {B.OBS}, f AS (SELECT batch, seq, regexp_extract(raw_text, '{_ISO}', 1) AS iso, regexp_extract(raw_text, '{_DMY}', ['d', 'm', 'y']) AS a, regexp_extract(raw_text, '{_MDY}', ['m', 'd', 'y']) AS b FROM obs)
SELECT batch, seq, CASE WHEN iso <> '' THEN CAST(try_cast(iso AS DATE) AS VARCHAR) WHEN a.d <> '' THEN CAST(CAST(try_strptime(a.d || ' ' || a.m || ' ' || a.y, '%d %B %Y') AS DATE) AS VARCHAR)
  WHEN b.d <> '' THEN CAST(CAST(try_strptime(b.d || ' ' || b.m || ' ' || b.y, '%d %B %Y') AS DATE) AS VARCHAR) END AS deadline FROM f""")
def deadlines(spark, sf):
    """The first date of each whole text."""
    return D.observations(spark, sf).select("batch", "seq", X.parse_deadline(F.col("raw_text")).cast("string").alias("deadline"))


@query(f"WITH {B.DETECTED} SELECT batch, seq, source_url, outcome, event_id, prev_hash FROM detected")
def changes(spark, sf):
    return B.detected(spark, sf).select("batch", "seq", "source_url", "outcome", "event_id", "prev_hash")


@query(f"WITH {B.DETECTED} SELECT batch, outcome, count(*) AS n FROM detected GROUP BY batch, outcome")
def change_counts(spark, sf):
    return G.change_counts(B.detected(spark, sf))


@query()
def change_events(spark, sf):
    return G.change_events(B.detected(spark, sf))


@query(f"WITH {B.OBS}, {B.VERSIONS} SELECT source_url, content_hash, source_type, first_seen_at, last_seen_at FROM versions")
def version_history(spark, sf):
    v = B.versions(spark, sf)
    return v.select("source_url", "content_hash", "source_type", F.unix_timestamp("first_seen_at").alias("first_seen_at"), F.unix_timestamp("last_seen_at").alias("last_seen_at"))


@query(f"WITH {B.OBS}, {B.VERSIONS} SELECT source_url, content_hash FROM versions QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY last_seen_at DESC, content_hash DESC) = 1")
def latest_versions(spark, sf):
    return G.latest_versions(B.versions(spark, sf)).select("source_url", "content_hash")


@query(f"""WITH {B.OBS}, h AS (SELECT content_hash, arg_min(source_url, batch * 100000000 + seq) AS source_url, min(batch) AS first_batch, max(batch) AS last_batch FROM obs GROUP BY 1)
SELECT content_hash, source_url, {D.START} + 86400 * last_batch AS last_seen, CASE WHEN first_batch = last_batch THEN 'inserted' ELSE 'updated' END AS outcome,
  (SELECT count(*) FROM obs o WHERE o.content_hash = h.content_hash AND o.batch = last_batch) AS repeats FROM h""")
def upsert(spark, sf):
    """All four batches, one after the other; outcome and repeats are those of the last batch that had the hash."""
    store = BucketStore(spark, f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}", G.DOCUMENTS, "content_hash")
    o = cut(D.observations(spark, sf), "observations")
    seen = None
    for b in range(4):
        said = G.keep_documents(store, b, o.where(F.col("batch") == b), F.timestamp_seconds(F.lit(D.START + DAY * b))).withColumn("batch", F.lit(b))
        seen = said if seen is None else seen.unionByName(said)
    last = seen.groupBy("content_hash").agg(F.max_by(F.struct("outcome", "repeats"), "batch").alias("l")).select("content_hash", "l.*")
    return store.state(3).select("content_hash", "source_url", F.unix_timestamp("last_seen_at").alias("last_seen")).join(last, "content_hash")


@query(f"""WITH {B.OBS}, n AS (SELECT unnest([1, 2, 3]) AS b), known AS (SELECT b, content_hash, max(artifact_uri) AS uri FROM obs JOIN n ON batch < b GROUP BY ALL)
SELECT batch, seq, CASE WHEN k.content_hash IS NOT NULL THEN uri ELSE 'artifacts/' || source_type || '/2024-01-0' || (batch + 1) || '/' || left(o.content_hash, 8) || '_text.txt' END AS artifact_uri, k.content_hash IS NOT NULL AS reused
FROM obs o LEFT JOIN known k ON o.content_hash = k.content_hash AND b = batch WHERE batch > 0""")
def archive(spark, sf):
    """Every batch but the first, each against the artifacts of those before."""
    o, out = cut(D.observations(spark, sf), "observations"), None
    for b in (1, 2, 3):
        known = o.where(F.col("batch") < b).groupBy("content_hash").agg(F.max("artifact_uri").alias("artifact_uri"))
        now = G.archive_keys(o.where(F.col("batch") == b), known).select("batch", "seq", "artifact_uri", "reused")
        out = now if out is None else out.unionByName(now)
    return out


@query(f"""WITH {B.DETECTED}, d AS (SELECT DISTINCT source_url, content_hash FROM obs)
SELECT d.source_url, d.content_hash, CASE WHEN v.source_url IS NULL THEN 'promoted+created' WHEN e.source_url IS NULL THEN 'created' ELSE 'existing' END AS provenance
FROM d LEFT JOIN (SELECT DISTINCT source_url, content_hash FROM obs WHERE batch < 2) v USING (source_url, content_hash) LEFT JOIN (SELECT DISTINCT source_url, content_hash FROM detected WHERE batch < 1) e USING (source_url, content_hash)""")
def promote(spark, sf):
    o = D.observations(spark, sf)
    return G.promote_and_create(o, o.where("batch < 2"), o.where("batch < 1"))


_PROMOTED = f"""WITH {B.DETECTED}, d AS (SELECT DISTINCT source_url, content_hash FROM obs)
SELECT CASE WHEN v.source_url IS NULL THEN 'promoted+created' WHEN e.source_url IS NULL THEN 'created' ELSE 'existing' END AS provenance, count(*) AS documents
FROM d LEFT JOIN (SELECT DISTINCT source_url, content_hash FROM obs WHERE batch < 2) v USING (source_url, content_hash) LEFT JOIN (SELECT DISTINCT source_url, content_hash FROM detected WHERE batch < 1) e USING (source_url, content_hash) GROUP BY 1"""


@query(_PROMOTED)
def provenance_counts(spark, sf):
    o = D.observations(spark, sf)
    return R.provenance_counts(G.promote_and_create(o, o.where("batch < 2"), o.where("batch < 1")))


@query(FILTER_SQL + f""", kept AS (SELECT * FROM r WHERE reason IN ('structural_marker', 'dense_short', 'passed')),
old AS (SELECT * FROM kept WHERE batch = 0), new AS (SELECT * FROM kept WHERE batch > 0),
fresh AS (SELECT DISTINCT content_hash FROM new WHERE content_hash NOT IN (SELECT content_hash FROM old)),
seen AS (SELECT batch, lag(content_hash) OVER (PARTITION BY source_url ORDER BY batch, seq) AS prev, row_number() OVER (PARTITION BY source_url, content_hash ORDER BY batch, seq) AS k FROM kept)
SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM new) - (SELECT count(*) FROM fresh) AS updated, (SELECT count(*) FROM fresh) AS archived,
  count(*) FILTER (k = 1 AND prev IS NULL) AS created, count(*) FILTER (k = 1 AND prev IS NOT NULL) AS modified, count(*) FILTER (k > 1) AS unchanged,
  (SELECT count(*) FROM r WHERE batch > 0 AND reason NOT IN ('structural_marker', 'dense_short', 'passed')) AS filtered,
  (SELECT string_agg(reason || ':' || n, ' ' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM r WHERE batch > 0 AND reason NOT IN ('structural_marker', 'dense_short', 'passed') GROUP BY 1)) AS reasons FROM seen WHERE batch > 0""")
def ingest_counters(spark, sf):
    """Batches 1 to 3 are ingested on what batch 0 left."""
    o = cut(D.observations(spark, sf), "observations")
    now = F.timestamp_seconds(F.lit(AS_OF))
    before = cut(G.apply_content_filter(o.where("batch = 0")), "before")
    archived = before.groupBy("content_hash").agg(F.max("artifact_uri").alias("artifact_uri"))
    versions = before.withColumn("batch", F.col("seq")).groupBy("source_url", "content_hash").agg(F.first("raw_text").alias("raw_text"), F.timestamp_micros(F.max("seq")).alias("last_seen_at"))
    out = J.ingest(o.where("batch > 0"), G.upsert_documents(None, before, now), archived, now, versions=versions)
    stats = J.ingest_stats(out["documents"], out["archive"], out["dropped"], out["changes"])
    said = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ")
    return stats.withColumn("reasons", said)


@query(f"WITH {B.OBS} SELECT source_type, language, count(*) AS docs, CAST(sum(length(raw_text)) AS BIGINT) AS text_chars, count(artifact_uri) AS archived FROM obs GROUP BY ALL")
def report_documents(spark, sf):
    return R.report_documents(D.observations(spark, sf))


@query(f"WITH {B.OBS}, {B.VERSIONS} SELECT source_type, count(DISTINCT source_url) AS unique_urls, count(*) AS versions_total, count(*) FILTER (first_seen_at > {AS_OF - DAY - 3600}) AS versions_last_hour FROM versions GROUP BY 1")
def report_versions(spark, sf):
    return R.report_versions(B.versions(spark, sf), F.timestamp_seconds(F.lit(AS_OF - DAY)))


@query(f"WITH {B.OBS} SELECT source_type, count(*) AS docs, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM obs GROUP BY 1")
def corpus_snapshot(spark, sf):
    return R.corpus_snapshot(D.observations(spark, sf))


@query(f"WITH {B.OBS} SELECT seq, source_type, language, left(title, 60) AS title, length(raw_text) AS chars, left(raw_text, 200) AS preview FROM obs ORDER BY fetched_at DESC, seq DESC LIMIT 3")
def latest_samples(spark, sf):
    return R.latest_samples(D.observations(spark, sf)).withColumn("chars", F.col("chars").cast("long"))


@query(f"WITH {B.OBS} SELECT count(*) FILTER (source_url LIKE '%cbp.gov%') AS cbp, count(*) FILTER (source_url LIKE '%europa.eu/doc/%') AS europa FROM obs")
def url_categories(spark, sf):
    return R.url_category_counts(D.observations(spark, sf), {"cbp": "%cbp.gov%", "europa": "%europa.eu/doc/%"})


_CODES = " UNION ALL ".join(f"SELECT batch, seq, {i} AS k, '{n}' AS pattern, unnest(regexp_extract_all(raw_text, '{p}')) AS surface FROM obs" for i, (n, p) in enumerate(C.CODE_PATTERNS))
CODES_SQL = f"WITH {B.OBS}, c AS ({_CODES}), pairs AS (SELECT seq AS doc_id, surface, arg_min(pattern, k) AS pattern FROM c GROUP BY 1, 2)"


@query(f"{CODES_SQL} SELECT doc_id, surface, pattern FROM pairs")
def mine_codes(spark, sf):
    return R.mine_codes(D.observations(spark, sf))


@query(f"{CODES_SQL} SELECT surface, count(*) AS docs FROM pairs GROUP BY 1 ORDER BY docs DESC, surface LIMIT 15")
def top_codes(spark, sf):
    return R.top_codes(R.mine_codes(D.observations(spark, sf)))


@query(f"{CODES_SQL} SELECT pattern, count(*) AS hits FROM pairs GROUP BY 1")
def code_pattern_hits(spark, sf):
    return R.pattern_hits(R.mine_codes(D.observations(spark, sf)))


@query(f"{CODES_SQL} SELECT (SELECT count(*) FROM obs) AS docs_scanned, count(DISTINCT doc_id) AS docs_with_code, count(*) AS mentions, count(DISTINCT surface) AS codes FROM pairs")
def code_totals(spark, sf):
    o = D.observations(spark, sf)
    return R.code_totals(o, cut(R.mine_codes(o), "codes"))


@query(f"WITH {B.OBS} SELECT DISTINCT source_url || '.PDF' AS source_url FROM obs WHERE doc_id % 7 = 3")
def code_bearing_pdfs(spark, sf):
    return R.code_bearing_pdfs(D.observations(spark, sf).withColumn("source_url", F.concat("source_url", F.lit(".PDF"))))


@query(f"WITH {B.OBS} SELECT batch, seq FROM obs WHERE fetched_at >= {AS_OF} - 2 * 86400")
def since_two_days(spark, sf):
    return R.since(D.observations(spark, sf), "fetched_at", "2d", F.timestamp_seconds(F.lit(AS_OF))).select("batch", "seq")


@query(f"""WITH {B.OBS}, h AS (SELECT DISTINCT source_url, regexp_extract(source_url, '://([^/]*)', 1) AS host FROM obs)
SELECT source_url, (SELECT arg_max(code, length(suffix)) FROM (VALUES {", ".join(f"({B.quoted([k])}, {B.quoted([v])})" for k, v in C.JURISDICTIONS.items())}) m(suffix, code) WHERE host = suffix OR ends_with(host, '.' || suffix)) AS jurisdiction FROM h""")
def jurisdictions(spark, sf):
    u = D.observations(spark, sf).select("source_url").distinct()
    return u.select("source_url", F.try_element_at(E.resolve_jurisdiction(F.col("source_url")), F.lit(1)).alias("jurisdiction"))
