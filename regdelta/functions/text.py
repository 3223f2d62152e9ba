"""Text columns: hashes, normal forms, filters, languages, quotes, dates, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regdelta import constants as C

BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    """Without blanks at either end."""
    return F.trim(text, F.lit(BLANKS))


def structural_marker(text: Column) -> Column:
    """The first mark of a paragraph, article, code or act; empty if there is none.

    Every mark is a number with a sign or word before or behind it: only texts that have such a word beside a
    number are searched in full.
    """

    def beside(piece: Column) -> Column:
        before, after = F.right(F.rtrim(piece, F.lit(BLANKS)), F.lit(7)), F.left(F.ltrim(piece, F.lit(BLANKS)), F.lit(3))
        return before.rlike(r"(?i)(?:§|article|art\.|section|sec\.|chapter|title|part|e[uc])$") | after.rlike(r"(?i)^(?:cfr|us|u\.)")

    return F.when(F.exists(F.split(text, "[0-9]+"), beside), F.regexp_extract(text, C.MARKER_PATTERN, 0)).otherwise("")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def normalize_for_hash(text: Column) -> Column:
    """Without markdown images, link targets and lines of table rulers; blanks collapsed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    lines = F.filter(F.transform(F.split(plain, r"\r\n|[\n\r\x0b\x0c]"), strip), lambda x: ~x.rlike(r"^[|\-*_ \t]*$"))
    return collapse(F.array_join(lines, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def bench_normalize(text: Column) -> Column:
    return collapse(F.coalesce(text, F.lit("")))


def detect_language(text: Column) -> Column:
    """Script shares of the first 4000 characters, then a vote of function words; null without letters."""
    return _once(F.left(F.coalesce(text, F.lit("")), F.lit(4000)), lambda head: _once(F.split(F.lower(head), r"[^\p{L}]+"), lambda words: _language(head, words)))


def _once(value: Column, use) -> Column:
    """use(value), the value being worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _language(head: Column, words: Column) -> Column:
    letters = F.length(F.regexp_replace(head, r"[\s\p{P}\p{S}\p{Z}]", ""))
    count = lambda cls: F.length(head) - F.length(F.regexp_replace(head, cls, ""))
    share = lambda cls: count(cls) / letters
    votes = F.array(*[F.struct(F.size(F.filter(words, lambda w: w.isin(*ws))).alias("n"), F.lit(k).alias("k")) for k, ws in sorted(C.FUNCTION_WORDS.items(), reverse=True)])
    best = F.array_max(votes)
    return (
        F.when(letters == 0, F.lit(None).cast("string"))
        .when(share("[가-힯ᄀ-ᇿ㄰-㆏]") > 0.1, "ko")
        .when(share("[぀-ゟ゠-ヿ]") > 0.1, "ja")
        .when(share("[一-鿿㐀-䶿豈-﫿]") > 0.1, "zh")
        .when(best["n"] > 0, best["k"])
    )


def blocker_reason(text: Column, title: Column) -> Column:
    low_title, n = F.lower(F.coalesce(title, F.lit(""))), F.length(text)
    head = F.lower(F.left(text, F.lit(C.BLOCKER_HEAD)))
    first = lambda where, options: F.try_element_at(F.filter(F.array(*map(F.lit, options)), lambda p: F.contains(where, p)), F.lit(1))
    in_title, in_body = first(low_title, C.BLOCKER_TITLES), first(head, C.BLOCKER_BODIES)
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(in_title.isNotNull(), F.concat(F.lit("title:'"), in_title, F.lit("'")))
        .when(in_body.isNotNull() & (n < C.BLOCKER_SHORT), F.concat(F.lit("body:'"), in_body, F.lit("'+short("), n.cast("string"), F.lit("c)")))
        .when(F.length(strip(text)) < C.BLOCKER_EMPTY, F.concat(F.lit("empty_body("), n.cast("string"), F.lit("c)")))
    )


def trim_middle(text: Column, head: int = C.Config.content_head, tail: int = C.Config.content_tail) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    marker = F.concat(F.lit("\n… [content truncated for scoring — "), F.length(t).cast("string"), F.lit(" chars total] …\n"))
    return F.when(F.length(t) <= head + tail, t).otherwise(F.concat(F.left(t, F.lit(head)), marker, F.right(t, F.lit(tail))))


def trim_diff(diff: Column, most: int = C.Config.diff_chars) -> Column:
    t = strip(F.coalesce(diff, F.lit("")))
    half = F.lit(most // 2)
    long = F.concat(F.left(t, half), F.lit("\n… [diff truncated for scoring] …\n"), F.right(t, half))
    return F.when(F.length(t) > most, long).when(t == "", "(no diff available for this modification)").otherwise(t)


def request_hash(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(12))


def quote_start(source: Column, quote: Column, least: int = C.Config.min_quote) -> Column:
    """Offset from 0 of the trimmed quote in the source, by blanks-tolerant search where it is not there as it stands; null if not found."""
    q = strip(quote)
    exact = F.instr(source, q) - 1
    loose = F.regexp_instr(source, _loose(q)) - 1
    return F.when(F.length(q) < least, F.lit(None).cast("int")).when(exact >= 0, exact).when(loose >= 0, loose)


def quote_end(source: Column, quote: Column, least: int = C.Config.min_quote) -> Column:
    q = strip(quote)
    exact = F.instr(source, q) - 1
    found = F.regexp_substr(source, _loose(q))
    start = F.regexp_instr(source, _loose(q)) - 1
    return F.when(F.length(q) < least, F.lit(None).cast("int")).when(exact >= 0, exact + F.length(q)).when(start >= 0, start + F.length(found))


def _loose(quote: Column) -> Column:
    """A pattern of the quote's words with any blanks between them."""
    words = F.transform(F.split(quote, r"\s+"), lambda w: F.regexp_replace(w, r"([\\\[\](){}.*+?^$|])", r"\\$1"))
    return F.array_join(words, r"\s+")


def parse_deadline(text: Column) -> Column:
    """The first form that occurs decides, valid or not: ISO date, day month year, month day, year."""
    names = "|".join(C.MONTHS)
    iso, dmy, mdy = r"\b(\d{4}-\d{2}-\d{2})\b", rf"(?i)\b(\d{{1,2}})\s+({names})\s+(\d{{4}})\b", rf"(?i)\b({names})\s+(\d{{1,2}}),\s*(\d{{4}})\b"
    month = lambda m: F.lpad(F.array_position(F.array(*[F.lit(x.lower()) for x in C.MONTHS]), F.lower(m)).cast("string"), 2, "0")
    g = lambda p, i: F.regexp_extract(text, p, i)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, month(m), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return (
        F.when(text.rlike(iso), F.try_to_date(g(iso, 1), "yyyy-MM-dd"))
        .when(text.rlike(dmy), day(g(dmy, 3), g(dmy, 2), g(dmy, 1)))
        .when(text.rlike(mdy), day(g(mdy, 3), g(mdy, 1), g(mdy, 2)))
    )


def obligation_key(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(strip(text)), r"\s+", " "), F.lit(""))


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    stride = size - overlap if size > overlap else size
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, size))).otherwise(F.array().cast("array<string>"))


def chunk_text(text: Column, size: int = C.Config.obligation_chunk, overlap: int = C.Config.obligation_overlap, most: int = C.Config.obligation_chunks) -> Column:
    """Paragraphs packed greedily up to the size; a longer paragraph is cut in overlapping pieces; at most `most` chunks."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n+"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc, p):
        flushed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        joined = F.concat_ws("\n\n", acc["open"], p)
        return (
            F.when(F.length(p) > size, F.struct(F.concat(flushed, fixed_chunks(p, size, overlap)).alias("done"), F.lit(None).cast("string").alias("open")))
            .when(F.length(joined) > size, F.struct(flushed.alias("done"), p.alias("open")))
            .otherwise(F.struct(acc["done"].alias("done"), joined.alias("open")))
        )

    finish = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
    packed = F.aggregate(paragraphs, start, add, finish)
    whole = F.when(F.size(paragraphs) == 0, fixed_chunks(text, size, overlap)).otherwise(packed)
    out = F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(whole)
    return F.slice(out, 1, most)


def extract_codes(text: Column) -> Column:
    """(pattern, surface) of every tariff code, pattern by pattern."""
    def of(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda s: F.struct(F.lit(name).alias("pattern"), F.trim(s).alias("surface")))

    found = [of(name, pattern) for name, pattern in C.CODE_PATTERNS]
    return F.concat(*found)


def table_to_text(rows: Column) -> Column:
    """Cells of a table as lines, between markers; null if there is none."""
    lines = F.filter(F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, lambda c: F.trim(c)), lambda c: c != ""), ", ")), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.concat(F.lit("--- TABLE ---\n"), F.array_join(lines, "\n"), F.lit("\n--- END TABLE ---")))
