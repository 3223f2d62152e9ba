"""Feeds, legal XML, registers, mail archives, page stitching, ledgers and lists: everything lands as documents."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regdelta.functions import text as X
from regdelta.functions import url as L
from regdelta.operators.changes import first_by
from regdelta.shipping import ship

DOCUMENT = "source_url string, source_type string, title string, raw_text string, language string, content_hash string, fetched_at timestamp"
SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, make: Callable[..., DataFrame]) -> None:
    """Any callable that returns a DataFrame of documents is a source."""
    SOURCES[name] = make


def read_source(spark: SparkSession, name: str, **options) -> DataFrame:
    return SOURCES[name](spark, **options)


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    docs = spark.read.schema(DOCUMENT).format(fmt).load(path)
    return docs.withColumn("content_hash", F.coalesce("content_hash", X.content_hash(F.col("raw_text"))))


def feed_items_to_documents(items: DataFrame, most: int = 100) -> DataFrame:
    """items: feed_url, feed_title, pos, title, link, summary, guid, published. First items of a feed, each identity once."""
    w = Window.partitionBy("feed_url").orderBy("pos")
    given = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    title, link, summary = given("title"), given("link"), given("summary")
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in (("Title", title), ("Published", given("published")), ("Summary", summary), ("Link", link))])
    identity = F.coalesce(given("guid"), link)
    first = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    docs = first.withColumn("raw_text", text).where(F.length(F.trim("raw_text")) >= 20)
    docs = docs.withColumn("content_hash", F.sha2(F.coalesce(F.concat("feed_url", F.lit("||"), identity), F.col("raw_text")), 256))
    docs = docs.select(
        "feed_url", "pos", F.coalesce(link, "feed_url").alias("source_url"), F.lit("rss").alias("source_type"), F.coalesce(title, "feed_title", "feed_url").alias("title"), "raw_text", "content_hash", X.detect_language(F.col("raw_text")).alias("language")
    )
    return first_by(docs, ["feed_url", "content_hash"], ["pos"])


def _xml_text(markup):
    return X.collapse(F.regexp_replace(markup, r"<[^>]+>", " "))


def legal_xml_sections(spark: SparkSession, path: str, title: str, row_tag: str = "section", section_key: bool = False, dated: bool = True, untitled: str = "Section") -> DataFrame:
    """One document per section, article or chapter of the files: heading and date in the title, all inner text.

    Children are read as markup, so their order is kept. All sections of a file have its path as url;
    section_key adds `#n` to tell them apart. dated: whether its own date is in the title of a section.
    """
    schema = "num string, heading string, content string, _effectiveDate string, _startDate string"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("source_url"), F.monotonically_increasing_id().alias("seq"))
    plain = {c: _xml_text(F.coalesce(c, F.lit(""))) for c in ("num", "heading", "content")}
    text = X.collapse(F.concat_ws(" ", *plain.values()))
    heading = F.coalesce(F.nullif(F.trim(F.concat_ws(" ", plain["num"], plain["heading"])), F.lit("")), F.lit(untitled))
    date = F.coalesce("_effectiveDate", "_startDate", F.lit("")) if dated else F.lit("")
    docs = rows.select(
        "seq", "source_url", F.lit("xml").alias("source_type"), text.alias("raw_text"),
        F.concat(F.lit(f"{title} — "), heading, F.when(date != "", F.concat(F.lit(" (effective: "), date, F.lit(")"))).otherwise("")).alias("title"),
    ).where(F.length("raw_text") >= 30)
    docs = docs.withColumns({"content_hash": X.content_hash(F.col("raw_text")), "language": X.detect_language(F.col("raw_text"))})
    docs = first_by(docs, ["source_url", "content_hash"], ["seq"])
    if section_key:
        w = Window.partitionBy("source_url").orderBy("seq")
        docs = docs.withColumn("source_url", F.concat("source_url", F.lit("#"), F.row_number().over(w).cast("string")))
    return docs


#: Root element and its attributes, after declarations and comments.
XML_ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z_][\w.:-]*)([^>]*)>"
# fixed values: namespaces and root elements by which a format is known
USLM_MARKS, AKN_MARKS = ("gpo.gov", "uslm"), ("oasis-open.org/legaldocml", "akomaNtoso")


def xml_formats(spark: SparkSession, path: str) -> DataFrame:
    """(source_url, format, published, xml) of each file: uslm, akn or generic by its root; published is the first FRBRdate."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_url"), F.col("value").alias("xml"))
    tag, space = F.regexp_extract("xml", XML_ROOT, 1), F.regexp_extract(F.regexp_extract("xml", XML_ROOT, 2), r"\bxmlns(?::uslm)?\s*=\s*[\"']([^\"']*)", 1)
    kind = F.when(space.contains(USLM_MARKS[0]) | F.lower(tag).contains(USLM_MARKS[1]), "uslm").when(space.contains(AKN_MARKS[0]) | tag.contains(AKN_MARKS[1]), "akn").otherwise("generic")
    return files.select("source_url", kind.alias("format"), F.regexp_extract("xml", r"<(?:\w+:)?FRBRdate\b[^>]*?\bdate\s*=\s*[\"']([^\"']*)", 1).alias("published"), "xml")


#: Elements that are documents, by format; of other formats it is the elements below the root.
XML_UNITS = {"uslm": ("section",), "akn": ("section", "article", "chapter")}
_UNIT = "source_url string, seq long, format string, published string, name string, heading string, date string, text string"


def _xml_units(url: str, kind: str, published: str, xml: str) -> list[tuple]:
    """The units of a file in the order in which they begin, nested ones too; a file that is no XML has none.

    Elements are let go as they end, but for those inside of a unit that is still open.
    """
    parser = ElementTree.XMLPullParser(("start", "end"))
    units, out, opened, depth, begun = XML_UNITS.get(kind), [], [], 0, 0
    words = lambda e: " ".join("".join(e.itertext()).split())
    try:
        parser.feed(xml)
        parser.close()
        for event, e in parser.read_events():
            tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
            is_unit = depth == (1 if event == "start" else 2) if units is None else tag in units
            depth += 1 if event == "start" else -1
            if event == "start":
                if is_unit:
                    opened.append(begun)
                    begun += 1
                continue
            if is_unit:
                seq = opened.pop()
                if units is None:
                    out.append((url, seq, kind, published, e.get("title") or e.get("id") or tag, "", "", words(e)))
                else:
                    parts = {c.tag.rpartition("}")[2]: words(c) for c in e if isinstance(c.tag, str)}
                    heading, body = (" ".join(filter(None, (parts.get(k, "") for k in keys))) for keys in (("num", "heading"), ("num", "heading", "content")))
                    out.append((url, seq, kind, published, tag, heading, e.get("effectiveDate") or e.get("startDate") or "", body))
            if not opened:
                e.clear()
    except ElementTree.ParseError:
        return []
    return sorted(out)


def _read_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _UNIT.split(", ")]
    for files in batches:
        for row in files.itertuples(index=False):
            yield pd.DataFrame(_xml_units(row.source_url, row.format, row.published, row.xml), columns=columns)


def legal_xml_documents(spark: SparkSession, path: str, title: str) -> DataFrame:
    """Documents of legal XML files of any format, by their root; seq is their order in the file.

    uslm: its sections, with their own dates; akn: its sections, articles and chapters, dated by the first FRBRdate of the file;
    others: the elements below the root with 50 characters or more. Equal texts of a file are one document. Each file is read once,
    by one task; `legal_xml_sections` splits a very large one, for a single tag.
    """
    ship(spark)
    units = xml_formats(spark, path).select("source_url", "format", "published", "xml").mapInPandas(_read_units, _UNIT)
    generic = F.col("format") == "generic"
    least = F.when(generic, 50).otherwise(30)
    named = F.when(generic, F.col("name")).otherwise(F.coalesce(F.nullif("heading", F.lit("")), F.when(F.col("format") == "akn", "Article").otherwise("Section")))
    date = F.when(F.col("format") == "akn", F.col("published")).otherwise(F.col("date"))
    docs = units.where(F.length("text") >= least).select(
        "source_url", "seq", F.lit("xml").alias("source_type"), F.col("text").alias("raw_text"),
        F.concat(F.lit(f"{title} — "), named, F.when(date != "", F.concat(F.lit(" (effective: "), date, F.lit(")"))).otherwise("")).alias("title"),
    )
    docs = docs.withColumns({"content_hash": X.content_hash(F.col("raw_text")), "language": X.detect_language(F.col("raw_text"))})
    return first_by(docs, ["source_url", "content_hash"], ["seq"])


REGISTER_TYPES = ("RULE", "PROPOSED_RULE", "PRESIDENTIAL_DOCUMENT")


def register_to_documents(index: DataFrame, bodies: DataFrame, as_of, days_back: int = 2, most: int = 200, types=REGISTER_TYPES) -> DataFrame:
    """index: document_number, title, abstract, type, agencies, publication_date, effective_on, html_url, body_html_url; bodies: url, text."""
    due = index.where(F.col("type").isin(*types) & (F.to_date("publication_date") >= F.date_sub(as_of, days_back)))
    due = due.orderBy(F.desc("publication_date"), "document_number").limit(most)
    b = bodies.select(F.col("url").alias("body_html_url"), F.col("text").alias("_body"))
    df = due.join(b, "body_html_url", "left")
    given = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    agencies = F.array_join(F.transform("agencies", lambda a: a["raw_name"]), ", ")
    fields = (("Title", given(F.col("title"))), ("Type", given(F.col("type"))), ("Agencies", given(agencies)), ("Published", given(F.col("publication_date"))), ("Effective", given(F.col("effective_on"))))
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])
    blocks = [F.coalesce(F.concat(F.lit(f"\n\n{k}:\n"), given(F.col(c))), F.lit("")) for k, c in (("Abstract", "abstract"), ("Body", "_body"))]
    docs = df.withColumn("raw_text", X.strip(F.concat(head, *blocks))).where(F.length("raw_text") >= 80)
    return docs.select(
        "document_number", F.coalesce("html_url", "body_html_url").alias("source_url"), F.lit("web").alias("source_type"), F.coalesce(given(F.col("title")), "document_number").alias("title"), "raw_text", F.lit("en").alias("language"), X.content_hash(F.col("raw_text")).alias("content_hash")
    )


MAIL = "source_url string, source_type string, title string, raw_text string, attachment string, content binary"


def _mail_rows(path: str, raw: bytes) -> list[tuple]:
    msg = email.message_from_bytes(raw, policy=email.policy.default)
    plain, markup, files = [], [], []
    for part in msg.walk():
        if part.is_multipart():
            continue
        name = part.get_filename() or ""
        attached = part.get_content_disposition() == "attachment"
        payload = part.get_payload(decode=True) or b""
        if name.lower().endswith(".pdf") and (attached or part.get_content_type() == "application/pdf"):
            files.append((name, payload))
        elif not attached and part.get_content_type() in ("text/plain", "text/html"):
            text = payload.decode(part.get_content_charset() or "utf-8", "replace")
            if part.get_content_type() == "text/plain":
                plain.append(text)
            elif not plain:
                markup.append(re.sub(r"<[^>]+>", " ", text))
    body = "\n".join([*markup, *plain]).strip()
    subject = str(msg.get("Subject", "(no subject)"))
    rows = [(f"{path}/attachment/{n}", "pdf", n, None, n, c) for n, c in files]
    if len(body) >= 50:
        head = f"Subject: {subject}\nFrom: {msg.get('From', '')}\nDate: {msg.get('Date', '')}\n\n{body}"
        rows.insert(0, (path, "email", subject, head, None, None))
    return rows


def mail_archive_to_documents(files: DataFrame) -> DataFrame:
    """files: path, content (of `binaryFile`). One row per message, and one per PDF attachment with its bytes and no text yet."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"]) for r in _mail_rows(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["source_url", "source_type", "title", "raw_text", "attachment", "content"])

    docs = files.select("path", "content").mapInPandas(run, MAIL)
    return docs.withColumns({"content_hash": X.content_hash(F.col("raw_text")), "language": X.detect_language(F.col("raw_text"))})


def stitch_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """pages: doc, n, text. One row per doc with raw_text, the offsets of its pages and their number; short pages are left out.

    A file's pages are few; they are gathered in order in its one row.
    """
    text = X.strip(F.coalesce("text", F.lit("")))
    kept = pages.select("doc", "n", text.alias("t")).where(F.length("t") >= least)
    w = Window.partitionBy("doc").orderBy("n")
    mark = F.concat(F.when(F.row_number().over(w) == 1, "").otherwise("\n\n"), F.lit("[[PAGE "), F.col("n").cast("string"), F.lit("]]\n\n"))
    kept = kept.withColumn("_mark", mark)
    size = F.length("_mark") + F.length("t")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.withColumn("start", (before + F.length("_mark")).cast("int")).withColumn("end", (F.col("start") + F.length("t")).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("n", "start", "end", "_mark", "t")))
    out = placed.groupBy("doc").agg(rows.alias("r"))
    return out.select(
        "doc", F.array_join(F.transform("r", lambda x: F.concat(x["_mark"], x["t"])), "").alias("raw_text"), F.transform("r", lambda x: F.struct(x["n"].alias("n"), x["start"].alias("start"), x["end"].alias("end"))).alias("pages"), F.size("r").alias("page_count")
    )


def slice_pages(docs: DataFrame) -> DataFrame:
    spread = docs.select("doc", "raw_text", F.inline("pages"))
    return spread.select("doc", "n", F.expr("substring(raw_text, start + 1, end - start)").alias("text"))


GOLDEN = "id string, source_url string, title string, diff_kind string, unified_diff string, content string, added_chars int, removed_chars int, expected struct<significance_score:struct<min:double,max:double>,change_type:string,topic:string,origin_countries:array<string>,trade_flow_direction:string,should_trigger_obligations:boolean>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1; large files are split as Spark splits them.

    A split reads the lines that begin in it, in order. How many there are in the splits before is counted first, a row for each split.
    """
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), block.alias("_block"), F.monotonically_increasing_id().alias("_row"))
    splits = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("file", "_block", "_first", before.alias("_before"))
    return lines.join(placed, ["file", "_block"]).select("file", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line"), "value")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones and comments are skipped, an entry that is not JSON fails the load with its file and line."""
    lines = numbered_lines(spark, path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    read = lines.withColumn("g", F.from_json("value", GOLDEN + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    said = F.concat(F.lit("not a JSON entry: "), "file", F.lit(", line "), F.col("line").cast("string"))
    sound = F.when(F.col("g._broken").isNull(), F.col("g")).otherwise(F.raise_error(said).cast(read.schema["g"].dataType))
    return read.select(sound.alias("g")).select("g.*").drop("_broken")


LEDGER = "ts timestamp, scope string, model string, event_id string, request_hash string, prompt_tokens int, completion_tokens int, latency_ms int"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path, mode="DROPMALFORMED").where("model is not null or scope is not null or prompt_tokens is not null")


def append_ledger(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("url string, kind string").csv(path, header=True)
    url = F.trim("url")
    kind = F.nullif(F.lower(F.trim(F.coalesce("kind", F.lit("")))), F.lit(""))
    return rows.where((url != "") & ~url.startswith("#")).select(url.alias("url"), F.coalesce(kind, L.infer_kind(url)).alias("kind"))


def write_archive(docs: DataFrame, path: str) -> None:
    """One folder for each source type and day."""
    docs.withColumn("dt", F.to_date("fetched_at")).write.mode("append").partitionBy("source_type", "dt").parquet(path)


def write_outbox(plan: DataFrame, path: str) -> None:
    plan.where("plan = 'to_send'").write.mode("append").parquet(path)


def write_bench(results: DataFrame, path: str) -> None:
    flat = results.withColumn("meta", F.to_json("meta")) if "meta" in results.columns and dict(results.dtypes)["meta"] != "string" else results
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    flat.write.mode("overwrite").json(f"{path}/json")


def write_eval(run: DataFrame, path: str) -> None:
    run.write.mode("overwrite").json(path)
