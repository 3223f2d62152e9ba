"""Queries: landing of pages, feeds, registers and stitched pages; frontier; registry changes; union and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from regdelta import constants as C
from regdelta.functions import text as X
from regdelta.functions import url as L
from regdelta.operators import alerts as A
from regdelta.operators import crawl
from regdelta.operators import reports as R
from regdelta.plans import base as B
from regdelta.plans import derived as D
from regdelta.plans.registry import query
from regdelta.sources import landing as S
from regdelta.sources import pages as P


@query()
def page_documents(spark, sf):
    return P.pages_to_documents(D.read(spark, sf, "pages"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title_len FROM pages")
def page_titles(spark, sf):
    html = F.col("html")
    return D.read(spark, sf, "pages").select("page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.length(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)).cast("long").alias("title_len"))


_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '<[^>]+>', chr(10), 'g')"
_SIGNS = "replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"


@query(rf"""WITH b AS (SELECT page_id, regexp_replace({_BARE}, '[ \t]+\n', chr(10), 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace({_SIGNS}, '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM b""")
def page_plain_text(spark, sf):
    return D.read(spark, sf, "pages").select("page_id", P.html_to_text(F.col("html")).alias("text"))


FEED = """items AS (SELECT 'https://feed' || CAST(doc_id % 3 AS VARCHAR) || '.example.com/rss' AS feed_url, 'Feed' AS feed_title, doc_id AS pos, CASE WHEN doc_id % 5 <> 0 THEN 'Item ' || CAST(doc_id AS VARCHAR) END AS title,
  CASE WHEN doc_id % 7 <> 0 THEN 'https://x.example.com/' || CAST(doc_id % 50 AS VARCHAR) END AS link, CASE WHEN doc_id % 11 <> 0 THEN trim(text) END AS summary, CASE WHEN doc_id % 2 = 0 THEN 'guid-' || CAST(doc_id % 90 AS VARCHAR) END AS guid FROM documents)"""


def _items(spark, sf):
    d, text = F.col("doc_id"), lambda c: c.cast("string")
    return D.read(spark, sf, "documents").select(
        F.concat(F.lit("https://feed"), text(d % 3), F.lit(".example.com/rss")).alias("feed_url"),
        F.lit("Feed").alias("feed_title"),
        d.alias("pos"),
        F.when(d % 5 != 0, F.concat(F.lit("Item "), text(d))).alias("title"),
        F.when(d % 7 != 0, F.concat(F.lit("https://x.example.com/"), text(d % 50))).alias("link"),
        F.when(d % 11 != 0, F.trim("text")).alias("summary"),
        F.when(d % 2 == 0, F.concat(F.lit("guid-"), text(d % 90))).alias("guid"),
        F.lit(None).cast("string").alias("published"),
    )


@query(f"""WITH {FEED}, f AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY pos) AS rn FROM items),
d AS (SELECT *, concat_ws(chr(10), 'Title: ' || title, 'Summary: ' || nullif(trim(summary), ''), 'Link: ' || link) AS raw_text FROM f WHERE rn <= 100),
h AS (SELECT *, sha256(coalesce(feed_url || '||' || coalesce(guid, link), raw_text)) AS content_hash FROM d WHERE length(trim(raw_text)) >= 20)
SELECT feed_url, pos, coalesce(link, feed_url) AS source_url, coalesce(title, feed_title) AS title, raw_text, content_hash FROM h QUALIFY row_number() OVER (PARTITION BY feed_url, content_hash ORDER BY pos) = 1""")
def feed_documents(spark, sf):
    return S.feed_items_to_documents(_items(spark, sf)).select("feed_url", "pos", "source_url", "title", "raw_text", "content_hash")


REGISTER = """idx AS (SELECT 'FR-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS document_number, CASE WHEN doc_id % 6 <> 0 THEN 'Notice ' || CAST(doc_id AS VARCHAR) END AS title, CASE WHEN doc_id % 4 <> 0 THEN trim(text, ' ' || chr(10)) END AS abstract,
  CASE doc_id % 4 WHEN 0 THEN 'RULE' WHEN 1 THEN 'PROPOSED_RULE' WHEN 2 THEN 'NOTICE' ELSE 'PRESIDENTIAL_DOCUMENT' END AS type, '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS publication_date,
  'https://r.example.com/' || CAST(doc_id AS VARCHAR) AS html_url, CASE WHEN doc_id % 3 <> 0 THEN trim(text, ' ' || chr(10)) END AS body FROM documents)"""


def _register(spark, sf):
    d = F.col("doc_id")
    docs = D.read(spark, sf, "documents")
    index = docs.select(
        F.concat(F.lit("FR-"), F.lpad(d.cast("string"), 9, "0")).alias("document_number"),
        F.when(d % 6 != 0, F.concat(F.lit("Notice "), d.cast("string"))).alias("title"),
        F.when(d % 4 != 0, X.strip(F.col("text"))).alias("abstract"),
        F.when(d % 4 == 0, "RULE").when(d % 4 == 1, "PROPOSED_RULE").when(d % 4 == 2, "NOTICE").otherwise("PRESIDENTIAL_DOCUMENT").alias("type"),
        F.array(F.struct(F.lit("Agency A").alias("raw_name")), F.struct(F.lit("Agency B").alias("raw_name"))).alias("agencies"),
        F.concat(F.lit("2024-01-"), F.lpad((1 + d % 28).cast("string"), 2, "0")).alias("publication_date"),
        F.lit(None).cast("string").alias("effective_on"),
        F.concat(F.lit("https://r.example.com/"), d.cast("string")).alias("html_url"),
        F.concat(F.lit("https://b.example.com/"), d.cast("string")).alias("body_html_url"),
    )
    bodies = docs.where(d % 3 != 0).select(F.concat(F.lit("https://b.example.com/"), d.cast("string")).alias("url"), "text")
    return index, bodies


@query(f"""WITH {REGISTER}, due AS (SELECT * FROM idx WHERE type <> 'NOTICE' AND publication_date >= '2024-01-18' ORDER BY publication_date DESC, document_number LIMIT 200),
t AS (SELECT *, trim(concat_ws(chr(10), 'Title: ' || title, 'Type: ' || type, 'Agencies: Agency A, Agency B', 'Published: ' || publication_date)
  || coalesce(chr(10) || chr(10) || 'Abstract:' || chr(10) || nullif(trim(abstract), ''), '') || coalesce(chr(10) || chr(10) || 'Body:' || chr(10) || nullif(body, ''), '')) AS raw_text FROM due)
SELECT document_number, html_url AS source_url, coalesce(title, document_number) AS title, sha256(raw_text) AS content_hash, length(raw_text) AS chars FROM t WHERE length(raw_text) >= 80""")
def register_documents(spark, sf):
    index, bodies = _register(spark, sf)
    out = S.register_to_documents(index, bodies, F.lit("2024-01-20").cast("date"))
    return out.select("document_number", "source_url", "title", "content_hash", F.length("raw_text").cast("long").alias("chars"))


PAGES = f"""pg AS (SELECT {D.div("doc_id", 4)} AS doc, doc_id % 4 + 1 AS n, trim(text, ' ' || chr(10)) AS t FROM documents WHERE length(trim(text, ' ' || chr(10))) >= 50),
m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc ORDER BY n) = 1 THEN '' ELSE chr(10) || chr(10) END || '[[PAGE ' || n || ']]' || chr(10) || chr(10) AS mark FROM pg)"""


def _stitched(spark, sf):
    d = D.read(spark, sf, "documents").select(F.expr(D.div("doc_id", 4)).alias("doc"), (F.col("doc_id") % 4 + 1).alias("n"), "text")
    return S.stitch_pages(d)


@query(f"WITH {PAGES} SELECT doc, sha256(string_agg(mark || t, '' ORDER BY n)) AS text_hash, count(*) AS page_count FROM m GROUP BY doc")
def stitch_pages(spark, sf):
    return _stitched(spark, sf).select("doc", F.sha2("raw_text", 256).alias("text_hash"), F.col("page_count").cast("long").alias("page_count"))


@query(f"WITH {PAGES} SELECT doc, n, t AS text FROM m")
def slice_pages(spark, sf):
    return S.slice_pages(_stitched(spark, sf))


@query(f"""WITH RECURSIVE edges AS ({D.duck_sql("edges")}), walk AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN edges ON node = src WHERE depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def frontier(spark, sf):
    pages = D.read(spark, sf, "pages")
    edges = D.derived(spark, "edges", pages=pages)
    seeds = pages.where("page_id = 0").select(F.col("page_id").alias("node"))
    return crawl.expand_frontier(edges, seeds)


_STEM = "regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
_QUERY = f"list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.') AND NOT list_contains([{B.quoted(C.TRACKING_PARAMS)}], lower(split_part(x, '=', 1)))))"


# links of the pages are absolute paths, so the SQL has no other form to resolve
@query(f"""WITH p AS (SELECT lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS root, {_STEM} AS stem, {_QUERY} AS q, html FROM pages WHERE starts_with(url, 'http')),
n AS (SELECT root, regexp_replace(split_part(root, '://', 2), '^[w.]+', '') AS host, root || CASE WHEN stem = '' THEN '/' ELSE stem END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url, html FROM p),
s AS (SELECT root, url, html FROM n WHERE host = 'example.com' OR ends_with(host, '.example.com')),
h AS (SELECT root, trim(unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1))) AS href FROM s),
l AS (SELECT DISTINCT root || CASE WHEN rtrim(href, '/') = '' THEN '/' ELSE rtrim(href, '/') END AS url FROM h WHERE starts_with(href, '/'))
SELECT url, CAST(0 AS INT) AS depth, 'html' AS class FROM s GROUP BY url
UNION ALL SELECT url, 1, 'html' FROM l WHERE url NOT IN (SELECT url FROM s)""")
def crawl_frontier(spark, sf):
    pages = D.read(spark, sf, "pages")
    seeds = pages.where(L.is_same_domain(F.col("url"), "example.com")).select("url", F.col("page_id").alias("pos"))
    return crawl.crawl_frontier(pages, seeds, "example.com", max_pages=None, max_pdfs=None, max_xmls=None).select("url", "depth", "class")


@query("""WITH log AS (SELECT c_custkey AS id, c_custkey % 4 AS op, c_nationkey FROM customer)
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'renamed' ELSE c_mktsegment END AS label, CASE WHEN c_custkey % 4 <> 1 THEN c_name END AS channel, CASE WHEN c_custkey % 4 = 1 THEN '200' ELSE '-' END AS updated_at FROM customer WHERE c_custkey % 4 <> 2
UNION ALL SELECT c_custkey + 1000000, 'new', CASE WHEN c_custkey % 8 = 3 THEN 'patched' END, CASE WHEN c_custkey % 8 = 3 THEN '300' ELSE '-' END FROM customer WHERE c_custkey % 4 = 3
UNION ALL SELECT c_custkey, 'again', NULL, '-' FROM customer WHERE c_custkey % 8 = 2""")
def registry_changes(spark, sf):
    c = D.read(spark, sf, "customer")
    table = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("channel"))
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    sent = F.create_map(F.lit("label"), F.lit("renamed"), F.lit("channel"), none)
    patches = c.where(k % 4 == 1).select(k.alias("id"), F.lit(2).alias("seq"), F.lit("patch").alias("op"), sent.alias("patch"))
    earlier = c.where(k % 4 == 1).select(k.alias("id"), F.lit(1).alias("seq"), F.lit("patch").alias("op"), F.create_map(F.lit("label"), F.lit("first")).alias("patch"))
    gone = c.where(k % 4 == 2).select(k.alias("id"), F.lit(1).alias("seq"), F.lit("delete").alias("op"), empty.alias("patch"))
    made = c.where(k % 4 == 3).select((k + 1_000_000).alias("id"), F.lit(1).alias("seq"), F.lit("create").alias("op"), F.create_map(F.lit("label"), F.lit("new")).alias("patch"))
    # creates of keys that are there and second creates are rejected, patches before a create as well; a deleted key may be made again
    sent = lambda label: F.create_map(F.lit("label"), F.lit(label))
    more = [
        c.where(k % 4 == 0).select(k.alias("id"), F.lit(1).alias("seq"), F.lit("create").alias("op"), sent("taken").alias("patch")),
        c.where(k % 4 == 3).select((k + 1_000_000).alias("id"), F.lit(2).alias("seq"), F.lit("create").alias("op"), sent("second").alias("patch")),
        c.where(k % 8 == 3).select((k + 1_000_000).alias("id"), F.lit(3).alias("seq"), F.lit("patch").alias("op"), F.create_map(F.lit("channel"), F.lit("patched")).alias("patch")),
        c.where(k % 4 == 3).select((k + 1_000_000).alias("id"), F.lit(0).alias("seq"), F.lit("patch").alias("op"), sent("too early").alias("patch")),
        c.where(k % 8 == 2).select(k.alias("id"), F.lit(2).alias("seq"), F.lit("create").alias("op"), sent("again").alias("patch")),
    ]
    log = patches.unionByName(earlier).unionByName(gone).unionByName(made)
    for part in more:
        log = log.unionByName(part)
    out = A.apply_registry_changes(table, log.withColumn("ts", F.timestamp_seconds(F.col("seq") * 100)), "id", ["label", "channel"])
    return out.withColumn("updated_at", F.coalesce(F.unix_timestamp("updated_at").cast("string"), F.lit("-")))


@query("SELECT c_custkey AS id, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS total FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 20 OFFSET 5")
def registry_listing(spark, sf):
    c = D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_mktsegment").alias("status"))
    return R.page_with_total(c, ["id"], 5, 20, "MACHINERY").select("id", "c_name", "total")


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 5")
def registry_page(spark, sf):
    c = D.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), "c_name")
    return R.page(c, ["id"], 5, 20)


@query()
def all_documents(spark, sf):
    """Union of what pages and feeds land."""
    return P.pages_to_documents(D.read(spark, sf, "pages")).unionByName(S.feed_items_to_documents(_items(spark, sf)), allowMissingColumns=True)
