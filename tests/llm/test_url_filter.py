from regdelta.llm import url_filter as U

SCHEMA = "page_id long, url string, host string, label string, features string"


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "https://EXAMPLE.org/en/12?x=1#y",
    "https://a.example.org/en/2",
    "https://example.org",
    "https://example.org?/es/",
    "https://notexample.org/es/1",
    "http://x.com/fr/1",
    "http://x.com/de/",
    "http://x.com/dealer",
    "http://x.net/a://b.org/",
    "ÄB://ÄX.Com/FR/",
    "http://x.net/" + "a/" * 50_000 + "?" + "&" * 1000,
]


def test_rules_and_parts(spark):
    rows = [(i, u, "h", "l", "f") for i, u in enumerate(URLS)] + [(None, "http://x.org/", None, None, None), (4, URLS[4], "", "", "")]
    got = U.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_trees_learn_what_the_rules_say(spark):
    """Blocked URLs are long and full of digits; so is one of the two that no rule fits."""
    rows = [(i, f"https://h{i % 7}.com/{'de' if i % 2 else 'fr'}/" + (f"{i:09d}" * 4 if i % 2 else "word"), "", "", "") for i in range(400)]
    rows += [(1001, "https://h.net/xx/" + "123456789" * 4, "", "", ""), (1002, "https://h.net/xx/word", "", "", "")]
    got = {r.page_id: r for r in U.judge_urls(spark.createDataFrame(rows, SCHEMA)).where("page_id > 1000").collect()}
    assert got[1001].verdict == "block" and got[1002].verdict == "allow"
    assert got[1001].block_score > 0.5 > got[1002].block_score


def test_nothing_to_learn(spark):
    only = spark.createDataFrame([(1, "http://a.net/", "", "", ""), (2, "http://x.com/de/", "", "", "")], SCHEMA)
    assert {r.page_id: r.verdict for r in U.judge_urls(only).collect()} == {1: "block", 2: "block"}
    none = spark.createDataFrame([(1, "http://a.net/", "", "", "")], SCHEMA)
    assert [r.verdict for r in U.judge_urls(none).collect()] == ["allow"]
    assert U.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
