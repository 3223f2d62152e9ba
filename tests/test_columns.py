"""Unit tables of column functions."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from regdelta.functions import entity as E
from regdelta.functions import text as X
from regdelta.functions import url as L
from regdelta.operators import changes as G
from regdelta.sources import pages as P


def each(spark, values, *columns, types="string"):
    """Values of the columns for every input, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {types}").select("i", *[c(F.col("v")).alias(f"c{k}") for k, c in enumerate(columns)])
    return [tuple(r)[1:] for r in frame.orderBy("i").collect()]


def test_deadlines(spark):
    cases = {"by 2026-06-30": "2026-06-30", "on 2026-02-30 or 1 May 2026": None, "30 June 2026": "2026-06-30", "30 february 2026": None, "March 5, 2027": "2027-03-05", "soon": None, "MAY 1,2026": "2026-05-01", "31 April 2026, or May 2, 2026": None}
    assert [r[0] for r in each(spark, cases, lambda v: X.parse_deadline(v).cast("string"))] == list(cases.values())


def test_quotes(spark):
    source = "One  sentence that\nstands here. Another  one with (brackets) and more of it."
    quotes = {"sentence that\nstands here": (5, 31), "sentence that stands here": (5, 31), "one with (brackets) and more": (41, 69), "short": (None, None), "nowhere to be found in it": (None, None)}
    found = each(spark, quotes, lambda v: X.quote_start(F.lit(source), v), lambda v: X.quote_end(F.lit(source), v))
    for (q, want), got in zip(quotes.items(), found):
        if want[0] is None:
            assert got == (None, None)
        else:
            assert source[got[0] : got[1]].split() == q.split()


def plain_chunks(text, size, overlap, most):
    import re

    if not text:
        return []
    if len(text) <= size:
        return [text]
    cut = lambda t: [t[i : i + size] for i in range(0, len(t), size - overlap)]
    out, open_ = [], None
    for p in [p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()]:
        if len(p) > size:
            out += ([open_] if open_ is not None else []) + cut(p)
            open_ = None
        elif open_ is not None and len(open_) + 2 + len(p) > size:
            out.append(open_)
            open_ = p
        else:
            open_ = p if open_ is None else f"{open_}\n\n{p}"
    return (out + ([open_] if open_ is not None else []))[:most]


def test_chunks(spark):
    rng = random.Random(4)
    texts = ["", "short", "x" * 95] + ["\n\n".join("w" * rng.randint(1, 60) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    assert [list(r[0]) for r in each(spark, texts, lambda v: X.chunk_text(v, 40, 7, 6))] == [plain_chunks(t, 40, 7, 6) for t in texts]


def test_entities(spark):
    cases = {
        "FCA": ("financial conduct authority", "Financial Conduct Authority", "agency"),
        " gdpr ": ("general data protection regulation", "General Data Protection Regulation", "regulation"),
        "AML": ("anti-money laundering", "Anti-Money Laundering", "agency"),
        "40 CFR": ("40 cfr", "40 CFR", "regulation"),
        "0304.29.00": ("0304.29.00", "0304.29.00", "code"),
        "Steel   importers": ("steel importers", "Steel importers", "industry"),
        "Ministry of Finance": ("ministry of finance", "Ministry of Finance", "agency"),
        "Green program": ("green program", "Green program", "program"),
        "Acme": ("acme", "Acme", "other"),
    }
    assert [tuple(r[0]) for r in each(spark, cases, E.normalize_entity)] == list(cases.values())
    assert each(spark, ["x", " ", ""], E.normalize_entity) == [(None,)] * 3


def test_countries_and_hosts(spark):
    names = [["China", "us", "UK", "Atlantis", "china", "xx"], [], None]
    assert [r[0] for r in each(spark, names, E.normalize_countries, types="array<string>")] == [["CN", "US", "GB", "XX"], [], []]
    hosts = {"https://www.trade.ec.europa.eu/x": ["EU"], "cbp.gov/a": ["US"], "http://www.hmrc.gov.uk:80/": ["GB"], "https://example.com": [], "https://weather.gov./": ["US"]}
    assert [r[0] for r in each(spark, hosts, E.resolve_jurisdiction)] == list(hosts.values())


def test_trade(spark):
    j, c = F.array(F.lit("US")), F.array(F.lit("CN"), F.lit("US"))
    got = each(spark, ["inbound", " Outbound", "bilateral", "global", None], *[lambda v, k=k: E.assign_trade(j, c, v)[k] for k in (0, 1)])
    assert got == [(["CN", "US"], ["US"]), (["US"], ["CN", "US"]), (["US", "CN"], ["US", "CN"]), (["CN", "US"], ["US"]), (["CN", "US"], ["US"])]


def test_urls(spark):
    cases = {
        "HTTP://WWW.Example.com/a/b/?b=2&a=1&utm_source=x&c=#frag": "http://www.example.com/a/b?a=1&b=2",
        "https://example.com": "https://example.com/",
        "https://example.com/p;v=1?q=a%20b": "https://example.com/p?q=a+b",
        "ftp://example.com/": None,
    }
    assert [r[0] for r in each(spark, cases, L.normalize_url)] == list(cases.values())
    traps = {"https://x.com/2024/05/01/": True, "https://x.com/?sid=1": True, "https://x.com/aa/aa/aa/": True, "https://x.com/a/b": False, "https://x.com/" + "y" * 600: True}
    assert [r[0] for r in each(spark, traps, L.is_spider_trap)] == list(traps.values())
    same = {"https://www.cbp.gov/x": True, "https://evil.com/cbp.gov": False, "https://a.cbp.gov": True, "cbp.gov": False}
    assert [r[0] for r in each(spark, same, lambda v: L.is_same_domain(v, "www.cbp.gov"))] == list(same.values())


def test_languages(spark):
    cases = {"이 규정은 수입업자에게 적용됩니다": "ko", "これは日本語のテキストです": "ja", "本法规适用于所有进口商": "zh", "the law of the land and the sea": "en", "der Zoll und die Ware": "de", "12 - 3": None}
    assert [r[0] for r in each(spark, cases, X.detect_language)] == list(cases.values())


def test_blockers(spark):
    long = "This is regulatory text. " * 100
    got = each(spark, [long, long + "cloudflare", "Please enable JavaScript " + "x" * 300, "tiny", ""], lambda v: X.blocker_reason(v, F.when(F.length(v) < 10, "Access Denied").otherwise("Page")))
    assert [r[0] for r in got] == [None, None, "body:'enable javascript'+short(325c)", "title:'access denied'", None]


def test_diffs_are_those_of_difflib(spark):
    pairs = [("a\nb\nc", "a\nx\nc"), ("", "new"), ("++old\nsame", "same\n--gone"), ("same", "same")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    text, added, removed = G.unified_diff(F.col("a"), F.col("b"))
    for r in frame.select("i", text.alias("t"), added.alias("p"), removed.alias("m")).collect():
        lines = list(difflib.unified_diff(pairs[r.i][0].splitlines(), pairs[r.i][1].splitlines(), "previous", "current", lineterm=""))
        body = [x for x in lines if not x.startswith(("+++", "---"))]
        assert r.t == "\n".join(lines)
        assert (r.p, r.m) == (sum(len(x) - 1 for x in body if x[0] == "+"), sum(len(x) - 1 for x in body if x[0] == "-"))


def test_tables_and_markdown(spark):
    table = [[["a ", None, " b"], ["", None], ["c", "d", "e"]], [[None]], None]
    assert [r[0] for r in each(spark, table, X.table_to_text, types="array<array<string>>")] == ["--- TABLE ---\na, b\nc, d, e\n--- END TABLE ---", None, None]
    md = "1. [Home](/)\n2. [Trade](/t)\n\n# Rule\n\nSkip to main content\n![](x.png)\n[![logo](l.png)](/)\n---\n| [a](u) | [b](v) |\nText with [link](#) kept.\n\n\n\n* item"
    assert each(spark, [md], P.clean_markdown) == [("# Rule\n\nText with link kept.\n\n* item",)]


PAGE = "<html><head><title> A  title </title></head><body><nav>menu</nav><div class='sidebar'>side</div><article><h1>Head</h1><p>{}</p></article><footer>foot</footer></body></html>"


@pytest.mark.parametrize("inner,has", [("word " * 60, True), ("few", False)])
def test_pages(inner, has):
    title, text = P.read_page(PAGE.format(inner))
    assert title == "A title"
    assert (text is not None) == has
    if has:
        assert text.startswith("Head") and "menu" not in text and "side" not in text and "foot" not in text


def test_structural_marker_is_that_of_the_whole_pattern(spark):
    import random

    from pyspark.sql import functions as F

    from regdelta import constants as C
    from regdelta.functions import text as X

    rng = random.Random(6)
    parts = ["§", "Art.", "article", "SEC.", "Section", "chapter", "Title", "part", "EU", "ec", "EEC", "CFR", "U.S.C.", "USC", "u.sc", "us", "12", "3/2019", "7", " ", "\n", "\t", "x", ".", "/", "été"]
    rows = [("".join(rng.choice(parts) + rng.choice(["", " ", "\n "]) for _ in range(rng.randrange(7))),) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "t string")
    got = frame.select(X.structural_marker(F.col("t")).alias("a"), F.regexp_extract("t", C.MARKER_PATTERN, 0).alias("b"))
    assert got.where("a <> b").count() == 0 and 200 < got.where("a <> ''").count() < 2900
