"""Link resolution against the standard library, the crawl frontier against a queue, markdown and rolling counts against plain loops."""

import random
from collections import deque
from datetime import datetime, timedelta, timezone
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from regdelta.functions import url as L
from regdelta.operators import crawl
from regdelta.operators import rolling as W
from regdelta.sources import pages as P

BASES = ("https://a.example.com/x/y/z.html?q=1#f", "http://a.example.com", "https://a.example.com/d/")
HREFS = ("", "#top", "?p=2", "b.html", "./b", "../b", "../../../b", "/r/s", "/r/../s/./t", "//h.example.com/x", "https://o.example.com/a?b=c", "c/..", "c/.", "mailto:x@y", "a?x=../y", "..")


def test_links_are_resolved_as_the_standard_library_does(spark):
    rows = spark.createDataFrame([(h, b) for h in HREFS for b in BASES] + [(None, BASES[0]), ("x", None)], "h string, b string")
    for r in rows.select("*", L.resolve_url(F.col("h"), F.col("b")).alias("u")).collect():
        if r.h is None or r.b is None:
            assert r.u is None
            continue
        want = urljoin(r.b, r.h)
        # canonical URLs have no fragment, and an empty path is the root
        clean = lambda u: (u or "").split("#")[0].replace(".com?", ".com/?").rstrip("/")
        assert clean(r.u) == clean(want), (r.h, r.b)


def web(seed):
    pick = random.Random(seed)
    names = [f"https://w.example.com/{d}/{i}" for i in range(30) for d in ("in", "out")]
    extra = ["https://else.example.org/in/1", "https://w.example.com/in/2024/05/01/x", "/in/f.pdf", "https://else.example.org/g.pdf", "/in/rules.xml", "/in/sitemap.xml", "/in/a.zip"]
    pages = []
    for n in names:
        links = [pick.choice(names + extra) for _ in range(pick.randrange(5))]
        pages.append((n, "".join(f'<a href="{x}">t</a>' for x in links), pick.random() < 0.7, links))
    return pages


def queue(pages, seeds, max_depth, max_pages):
    """The crawl as a queue: visited (url, depth) in order, pdf and xml links in order."""
    by_url = {u: (kept, links) for u, _, kept, links in pages}
    todo, visited, reached, files, kept = deque((s, 0) for s in seeds), set(seeds), [], [], 0
    while todo and kept < max_pages:
        url, depth = todo.popleft()
        reached.append((url, depth))
        ok, links = by_url.get(url, (False, []))
        kept += ok
        for x in links if depth < max_depth else ():
            x = urljoin(url, x)
            if x.endswith(".zip"):
                continue
            kind = "pdf" if x.endswith(".pdf") else "xml" if x.endswith("rules.xml") else None
            if kind:
                if (x, kind) not in files:
                    files.append((x, kind))
            elif x not in visited and x.startswith("https://w.example.com/in/") and "/2024/" not in x:
                visited.add(x)
                todo.append((x, depth + 1))
    return reached, files


@pytest.mark.parametrize("seed,most", [(1, 1000), (2, 5), (3, 1)])
def test_frontier_is_that_of_a_queue(spark, seed, most):
    pages = web(seed)
    seeds = [p[0] for p in pages[:6:2]]
    table = spark.createDataFrame([p[:3] for p in pages], "url string, html string, kept boolean")
    starts = spark.createDataFrame(list(zip(seeds, range(len(seeds)))), "url string, pos int")
    got = crawl.crawl_frontier(table, starts, "example.com", "/in/", 3, most, 1000, 1000).orderBy("depth", "trail").collect()
    reached, files = queue(pages, seeds, 3, most)
    assert [(r.url, r.depth) for r in got if r["class"] == "html"] == reached
    assert sorted((r.url, r["class"]) for r in got if r["class"] != "html") == sorted(files)


def test_frontier_of_empty_tables(spark):
    none = spark.createDataFrame([], "url string, html string")
    starts = spark.createDataFrame([("https://a.example.com/x", 0), (None, 1), ("ftp://a", 2)], "url string, pos int")
    assert [tuple(r)[:3] for r in crawl.crawl_frontier(none, starts, "example.com").collect()] == [("https://a.example.com/x", 0, "html")]
    assert crawl.crawl_frontier(none, starts.limit(0), "example.com").count() == 0


MARKDOWN = {
    "1. [Home](/)\n2. [Rules](/r)\n\n# Title\ntext": "# Title\ntext",
    "1. Home\n\n# Title": "# Title",
    "1. First duty of all\ntext": "1. First duty of all\ntext",
    "![](a.png)\n[![logo](b.png)](/home)\ntext ![](c.png) end": "text  end",
    "see [this](javascript:void(0)) and [that](#) and [real](/r)": "see this and that and [real](/r)",
    "| [A](/a) | [B](/b) |\n|---|---|\n| Country of origin | Rate of duty in percent |": "| Country of origin | Rate of duty in percent |",
    "***\n---\n**Skip to main content**\na\n\n\n\nb": "a\n\nb",
    "1. One\n2. Two": "",
    "": "",
}


def test_markdown(spark):
    rows = spark.createDataFrame([(k,) for k in MARKDOWN], "md string")
    assert {r.md: r.c for r in rows.select("md", P.clean_markdown(F.col("md")).alias("c")).collect()} == MARKDOWN


def test_rolling_counts_and_breakers_of_one_hot_key(spark):
    pick, zero = random.Random(5), datetime(2024, 1, 1, tzinfo=timezone.utc)
    calls = [(i, pick.choice("aaab"), zero + timedelta(seconds=pick.randrange(4000)), pick.random() < 0.6) for i in range(400)]
    table = spark.createDataFrame(calls, "id int, scope string, ts timestamp, failed boolean")
    count = lambda s, t: sum(1 for _, q, u, bad in calls if bad and q == s and t - timedelta(seconds=60) < u <= t)
    trips = [(s, t) for _, s, t, bad in calls if bad and count(s, t) >= 4]
    assert {r.id: r.failures for r in W.rolling_failures(table, 60, 4).collect()} == {i: count(s, t) for i, s, t, bad in calls if bad}
    intervals = W.breaker_intervals(table, 60, 4, 45)
    assert intervals.agg(F.sum("trips")).first()[0] == len(trips) > 20
    want = {i: any(s == q and u <= t < u + timedelta(seconds=45) for q, u in trips) for i, s, t, _ in calls}
    got = W.is_open(table, intervals).collect()
    assert len(got) == len(calls) and {r.id: r.open for r in got} == want
