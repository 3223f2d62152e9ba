"""Table jobs on small inputs: matching, alerts, rolling counts, landing, streams."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from regdelta import constants as C
from regdelta.functions.stem import stem
from regdelta.operators import alerts as A
from regdelta.operators import changes as G
from regdelta.operators import matching as M
from regdelta.operators import rolling as W
from regdelta.operators import scoring as S
from regdelta.sources import landing as Land
from regdelta.streaming import jobs as J

START = datetime(2024, 1, 1)


def sequential_outcomes(log):
    """The rule said step by step: same (url, hash) ever seen is unchanged, else compare with the last one."""
    seen, last, out = set(), {}, []
    for url, h, batch, seq in sorted(log, key=lambda r: (r[2], r[3])):
        kind = "unchanged" if (url, h) in seen else "modified" if url in last else "created"
        out.append((url, h, batch, seq, kind, last.get(url)))
        seen.add((url, h))
        last[url] = h
    return sorted(out, key=str)


def random_log(n, seed):
    rng = random.Random(seed)
    return [(f"u{rng.randint(0, 6)}", f"h{rng.randint(0, 4)}", rng.randint(0, 5), i) for i in range(n)]


def observed(spark, log):
    rows = [(u, h, f"text {h}", b, s, START + timedelta(days=b), s) for u, h, b, s in log]
    return spark.createDataFrame(rows, "source_url string, content_hash string, raw_text string, batch int, seq long, fetched_at timestamp, doc_id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_follow_the_sequential_rule(spark, seed):
    log = random_log(120, seed)
    got = G.detect_changes(observed(spark, log)).select("source_url", "content_hash", "batch", "seq", "outcome", "prev_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == sequential_outcomes(log)


def test_replaying_a_batch_changes_nothing(spark):
    log = random_log(60, 3)
    again = log + [(u, h, b + 10, s + 1000) for u, h, b, s in log]
    late = G.detect_changes(observed(spark, again)).where("batch >= 10 and outcome <> 'unchanged'")
    assert late.count() == 0


def words(t):
    return re.findall(r"\d+(?:\.\d+)+|\w+", t.lower())


def spoken(t):
    """Stems with their places, stop words left out."""
    return [(i, stem(w)) for i, w in enumerate(words(t)) if w not in C.STOP_WORDS]


def follows(t, *steps):
    """Whether the text has the stems at these distances from the first one."""
    at = spoken(t)
    return any(all((i + d, s) in at for d, s in steps) for i, _ in at)


RULES = {
    "k & b": lambda w, t: {"k", "b"} <= w,
    "k | (b & !c)": lambda w, t: "k" in w or ("b" in w and "c" not in w),
    "!(k | b) & d": lambda w, t: not {"k", "b"} & w and "d" in w,
    "alp:* & !k": lambda w, t: any(x.startswith("alp") for x in w) and "k" not in w,
    "!k": lambda w, t: "k" not in w,
    "q:*": lambda w, t: any(x.startswith("q") for x in w),
    "!q:* & b": lambda w, t: not any(x.startswith("q") for x in w) and "b" in w,
    "the & batteries": lambda w, t: "batteri" in w,
    "the | of": lambda w, t: False,
    "!the | c": lambda w, t: "c" in w,
    "batteries <-> of <-> importing": lambda w, t: follows(t, (0, "batteri"), (2, "import")),
    "'battery of imports' | d": lambda w, t: "d" in w or follows(t, (0, "batteri"), (2, "import")),
    "k <2> b & !d": lambda w, t: follows(t, (0, "k"), (2, "b")) and "d" not in w,
    "9401.61": lambda w, t: "9401.61" in w,
    "dying": lambda w, t: "die" in w,
    "(k|b|c|d)&(alpha|quay|b|c)&(k|d|battery|quiet)&!(importer&quay)": lambda w, t: bool({"k", "b", "c", "d"} & w and {"alpha", "quay", "b", "c"} & w and {"k", "d", "batteri", "quiet"} & w) and not {"import", "quay"} <= w,
}
BROKEN = ["k &", "(k", "k b", "(k | b) <-> c", "k <-> ", "| k"]


def test_keyword_rules(spark):
    rng = random.Random(5)
    vocabulary = ["k", "b", "c", "d", "alpha", "Alp", "quay", "Quiet", "battery of importers", "batteries", "the", "9401.61", "9401", "dies", "b"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 5))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    subs = spark.createDataFrame(list(enumerate([*RULES, *BROKEN, None, " "])), "rule int, keyword_query string")
    good, bad = M.validate_rules(subs)
    n = len(RULES)
    assert sorted(r.rule for r in bad.collect()) == list(range(n, n + len(BROKEN)))
    rules = good.where("program is not null")
    judged = {(r.doc, r.rule): r.holds for r in M.judge_rules(docs, rules).collect()}  # where they are not as in an empty text
    is_open = {r.rule: r.open for r in rules.collect()}
    sets = [{s for _, s in spoken(t)} for t in texts]
    for d, t in enumerate(texts):
        for r, (rule, f) in enumerate(RULES.items()):
            assert judged.get((d, r), is_open[r]) == f(sets[d], t), (t, rule)
    got = {(r.doc, r.rule) for r in M.percolate(docs, rules).collect()}
    assert got == {(d, r) for d, t in enumerate(texts) for r, f in enumerate(RULES.values()) if not is_open[r] and f(sets[d], t)}


def evaluate(program, met):
    stack = []
    for x in program:
        if x == "!":
            stack.append(not stack.pop())
        elif x in "&|":
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if x == "&" else a or b)
        else:
            stack.append(x in met)
    return stack[0]


def random_rule(rng, depth, terms):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(terms)
    if rng.random() < 0.3:
        return f"!({random_rule(rng, depth - 1, terms)})"
    return f"({random_rule(rng, depth - 1, terms)} {rng.choice('&|')} {random_rule(rng, depth - 1, terms)})"


def test_covers_leave_out_no_text():
    rng = random.Random(11)
    for _ in range(400):
        rule = M._Rule(random_rule(rng, 4, ["u", "v", "w", "x", "y"]))
        n, costs = len(rule.terms), [rng.randrange(9) for _ in rule.terms]
        chosen = {str(i) for i in M.cover(rule.program, rule.open(), costs)}
        for bits in range(1 << n):
            met = {str(i) for i in range(n) if bits >> i & 1}
            assert evaluate(rule.program, met) == rule.open() or met & chosen
    common_and_rare = M._Rule("common & rare")
    assert M.cover(common_and_rare.program, False, [900, 2]) == [1] and M.cover(common_and_rare.program, False, [2, 900]) == [0]


def test_a_rule_is_judged_where_it_can_hold(spark, monkeypatch):
    seen = []
    real = M._candidates
    monkeypatch.setattr(M, "_candidates", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.createDataFrame([(i, f"common words rare{i % 500}x") for i in range(1000)], "doc int, text string")
    subs = spark.createDataFrame([(i, f"common & rare{i}x") for i in range(500)] + [(500, "common & (rare1x | rare2x) & !rare3x"), (501, "!(common & rare7x)")], "rule int, keyword_query string")
    rules = M.validate_rules(subs)[0]
    got = {(r.doc, r.rule): r.holds for r in M.judge_rules(docs, rules).collect()}
    want = {(i, i % 500): True for i in range(1000)} | {(i, 500): True for i in (1, 2, 501, 502)} | {(i, 501): False for i in (7, 507)}
    assert got == want
    assert seen[0].count() == len(want)


def test_deep_rules_work_and_far_phrases_are_invalid(spark):
    deep = {"!" * 3000 + "k": "k", "(" * 3000 + "k" + ")" * 3000: "k", "!" * 3001 + "k": "b", "k" + " & k" * 3000: "k"}
    subs = spark.createDataFrame(list(enumerate([*deep, "k <99999999999> b", "k <16384> b", "(" * 3000 + "k"])), "rule int, keyword_query string")
    good, bad = M.validate_rules(subs)
    assert sorted(r.rule for r in bad.collect()) == [4, 6]
    docs = spark.createDataFrame([("k", "k"), ("b", "b")], "doc string, text string")
    rules = good.where("rule < 4")
    is_open = {r.rule: r.open for r in rules.collect()}
    judged = {(r.doc, r.rule): r.holds for r in M.judge_rules(docs, rules).collect()}
    assert all(judged.get((d, i), is_open[i]) == (d == want) for i, want in enumerate(deep.values()) for d in "kb")


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_events_meet_subscriptions(spark, monkeypatch, most):
    """Classes in one index or several, open rules, joins of both kinds give what each pair by itself gives."""
    monkeypatch.setattr(M, "BROADCAST_CLASSES", most)
    monkeypatch.setattr(M, "BLOCK_CLASSES", max(most, 7))
    monkeypatch.setattr(M, "BROADCAST_WORDS", most)
    rng = random.Random(9)
    some = lambda values: rng.sample(values, rng.randint(1, 2)) if rng.random() < 0.6 else None
    rules = [None, "steel", "!steel", "steel & !zinc", "iron | zinc", "tin &"]
    subs = [(i, some(["t1", "t2", "t3"]), some(["CN", "US"]), some(["DE", "FR"]), rng.choice([0.0, 0.5, 0.9]), rng.choice(rules), rng.random() < 0.9) for i in range(80)]
    events = [(f"e{i}", rng.choice(["t1", "t2", None]), rng.choice([0.2, 0.6, 0.95, None]), rng.choice([[], ["CN"], ["US", "JP"], None]), rng.choice([[], ["DE"], None])) for i in range(40)]
    texts = [(f"e{i}", rng.choice(["steel", "zinc and steel", "iron", "", None, "nothing"])) for i in range(35)]
    e = spark.createDataFrame(events, "event_id string, topic string, significance_score double, origin_countries array<string>, destination_countries array<string>")
    s = spark.createDataFrame(subs, "id long, topics array<string>, origins array<string>, destinations array<string>, min_significance double, keyword_query string, is_active boolean")
    t = spark.createDataFrame(texts, "event_id string, text string")
    words_of = {k: set((x or "").split()) for k, x in texts}
    holds = {None: lambda w: True, "steel": lambda w: "steel" in w, "!steel": lambda w: "steel" not in w, "steel & !zinc": lambda w: "steel" in w and "zinc" not in w, "iron | zinc": lambda w: bool({"iron", "zinc"} & w), "tin &": lambda w: False}
    meet = lambda rule, own: rule is None or not own or bool(set(rule) & set(own))
    want = {
        (i, k)
        for i, topics, origins, destinations, least, rule, active in subs
        for k, topic, score, o, d in events
        if active and score is not None and words_of.get(k) and score >= least and (topics is None or topic in topics) and meet(origins, o) and meet(destinations, d) and holds[rule](words_of[k])
    }
    got = [(r.subscription_id, r.event_id) for r in M.match_events(e, t, s).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    known = spark.createDataFrame([x for x in sorted(want)[::3]], "subscription_id long, event_id string")
    statuses, fresh = M.match_job(e, t, s, known)
    assert fresh.count() == len(want) - known.count()
    by_id = {r.event_id: r for r in statuses.collect()}
    for k, _, score, *_ in events:
        assert by_id[k].status == ("unscored" if score is None else "matched" if words_of.get(k) else "no_text")
        assert by_id[k].alerts_created == sum(e == k for _, e in want - set(sorted(want)[::3]))


def test_workflow(spark):
    steps = ["assign:me", "in_progress", "in_progress", "done", "done:fixed", "open", "comment:late", "unassign", "unassign", "due_date:2024-05-01", "due_date:2024-05-01", "fly"]
    rows = [(1, START + timedelta(minutes=i), i, "u", *(s.split(":") + [None])[:2]) for i, s in enumerate(steps)]
    random.Random(1).shuffle(rows)
    r = A.replay_workflow(spark.createDataFrame(rows, "alert_id long, ts timestamp, seq long, actor string, action string, value string")).first()
    assert (r.status, r.note, r.assigned_to, r.due_date, r.applied, r.comments) == ("done", "fixed", None, "2024-05-01", 6, 1)
    assert [(x.seq, x.code) for x in r.rejects] == [(3, "missing_resolution_note"), (5, "invalid_transition"), (11, "bad_status")]


def test_breaker(spark):
    at = [0, 10, 20, 59, 60, 61, 400, 401, 402, 403]
    calls = spark.createDataFrame([("s", START + timedelta(seconds=x), True) for x in at], "scope string, ts timestamp, failed boolean")
    trips = [r.tripped for r in W.rolling_failures(calls, 60, 4).orderBy("ts").collect()]
    assert trips == [False, False, False, True, True, True, False, False, False, True]
    spans = [((r.opened_at - START).seconds, (r.open_until - START).seconds, r.trips) for r in W.breaker_intervals(calls, 60, 4, 300).orderBy("opened_at").collect()]
    assert spans == [(59, 361, 3), (403, 703, 1)]


def test_scores_are_validated(spark):
    base = '"change_type": "critical", "compliance_summary": "s"'
    cases = {
        '{"significance_score": 0.9, "topic": "nope", "affected_entities": [" A", "a", "", "B"], "trade_flow_direction": " Inbound ", %s}' % base: (0.9, "other", ["A", "B"], "inbound", None),
        '{"significance_score": "0.5", "trade_flow_direction": "sideways", %s}' % base: (0.5, "other", [], None, None),
        '{"significance_score": 1.2, %s}' % base: (None, None, None, None, "parse_error"),
        '{"significance_score": 0.2, "change_type": "huge", "compliance_summary": "s"}': (None, None, None, None, "parse_error"),
        '{"significance_score": 0.2, "change_type": "critical"}': (None, None, None, None, "parse_error"),
        "{broken": (None, None, None, None, "parse_error"),
    }
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, body string").select("i", S.parse_score(F.col("body")).alias("p")).orderBy("i")
    assert [(r.p.significance_score, r.p.topic, r.p.affected_entities, r.p.flow, r.p.error) for r in frame.collect()] == list(cases.values())


def test_stitched_pages_slice_back(spark):
    pages = [("d", 1, "x" * 60), ("d", 2, "short"), ("d", 3, "  " + "y" * 70), ("e", 1, "z" * 50)]
    docs = Land.stitch_pages(spark.createDataFrame(pages, "doc string, n int, text string"))
    assert {(r.doc, r.n): r.text for r in Land.slice_pages(docs).collect()} == {("d", 1): "x" * 60, ("d", 3): "y" * 70, ("e", 1): "z" * 50}
    assert {r.doc: r.page_count for r in docs.collect()} == {"d": 2, "e": 1}


def test_legal_xml(spark, tmp_path):
    (tmp_path / "law.xml").write_text(
        '<law><section effectiveDate="2024-01-01"><num>§ 1</num><heading>Scope</heading><content>All <b>importers</b> of steel must register here.</content></section>'
        "<section><num>§ 2</num><content>too short</content></section>"
        "<section><heading>Last</heading><content>Banks report what they hold, every single year.</content></section></law>"
    )
    rows = Land.legal_xml_sections(spark, str(tmp_path), "Law").orderBy("seq").collect()
    assert [r.title for r in rows] == ["Law — § 1 Scope (effective: 2024-01-01)", "Law — Last"]
    assert "All importers of steel must register here." in rows[0].raw_text


def test_legal_xml_by_the_root_of_each_file(spark, tmp_path):
    duty = "Importers of steel have to register before the first of May."
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?><!-- c --><uscDoc xmlns="http://schemas.gpo.gov/xml/uslm"><section startDate="2024-02-01"><num>1</num><content>{duty}</content></section><note>{duty} This is no section.</note></uscDoc>')
    (tmp_path / "b.xml").write_text(
        '<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><meta><FRBRdate date="2023-03-03" name="x"/><FRBRdate date="2024-01-01"/></meta>'
        f"<body><article><num>Art. 2</num><content>{duty}</content></article><section><content>{duty} Twice a year.</content></section></body></act></akomaNtoso>"
    )
    (tmp_path / "c.xml").write_text(f'<law><part title="First">{duty}</part><part id="p2">{duty}</part><part id="p3">under fifty characters</part><rule>Banks <b>report</b> what they hold, every single year, to the registry.</rule></law>')
    (tmp_path / "d.xml").write_text("no markup at all")
    rows = Land.legal_xml_documents(spark, str(tmp_path), "Law").collect()
    got = sorted((r.source_url[-5:], r.title) for r in rows)
    assert got == [("a.xml", "Law — 1 (effective: 2024-02-01)"), ("b.xml", "Law — Art. 2 (effective: 2023-03-03)"), ("b.xml", "Law — Article (effective: 2023-03-03)"), ("c.xml", "Law — First"), ("c.xml", "Law — rule")]
    assert "Banks report what they hold" in next(r.raw_text for r in rows if r.title == "Law — rule")


def test_legal_xml_in_one_read_and_in_order(spark, tmp_path):
    text = lambda n: f"<content>Paragraph {n} says that importers have to register with us.</content>"
    body = f'<chapter><num>I</num>{text(1)}<section><num>1</num>{text(2)}<article><num>A</num>{text(3)}</article></section><article><num>B</num>{text(4)}</article></chapter><section><num>2</num>{text(5)}</section><section>{text(2)}<num>1</num></section>'
    (tmp_path / "a.xml").write_text(f'<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><body>{body}</body></akomaNtoso>')
    docs = Land.legal_xml_documents(spark, str(tmp_path), "Law")
    got = [(r.title, r.raw_text.split()[2] if r.raw_text[0] != "P" else "") for r in docs.orderBy("seq").collect()]
    assert got == [("Law — I", "1"), ("Law — 1", "2"), ("Law — A", "3"), ("Law — B", "4"), ("Law — 2", "5")]
    assert docs._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan") == 1


def test_mail(spark, tmp_path):
    body = "This notice says that importers have new duties from May on."
    (tmp_path / "a.eml").write_text(f"Subject: Notice\nFrom: a@x.org\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nContent-Type: text/plain\n\n{body}\n")
    (tmp_path / "b.eml").write_text(
        'Subject: Files\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/html\n\n<p>hi</p>\n--q\nContent-Type: application/pdf\n'
        'Content-Disposition: attachment; filename="r.pdf"\nContent-Transfer-Encoding: base64\n\nJVBERg==\n--q--\n'
    )
    rows = Land.mail_archive_to_documents(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    mail = next(r for r in rows if r.source_type == "email")
    pdf = next(r for r in rows if r.source_type == "pdf")
    assert mail.raw_text.startswith("Subject: Notice\nFrom: a@x.org\n") and mail.raw_text.endswith(body) and len(rows) == 2
    assert bytes(pdf.content) == b"%PDF" and pdf.source_url.endswith("/attachment/r.pdf")


def test_lists_and_ledgers(spark, tmp_path):
    (tmp_path / "urls.csv").write_text("url,kind\nhttps://x.com/a.pdf,\n# note,\n https://x.com/feed.xml ,\nhttps://x.com,WEB\n")
    assert sorted((r.url, r.kind) for r in Land.read_url_list(spark, str(tmp_path / "urls.csv")).collect()) == [("https://x.com", "web"), ("https://x.com/a.pdf", "pdf"), ("https://x.com/feed.xml", "rss")]
    (tmp_path / "ledger.jsonl").write_text('{"scope": "scoring", "model": "gpt-4o", "prompt_tokens": 5}\n{"scope": "sco\n')
    assert [r.model for r in Land.read_ledger(spark, str(tmp_path / "ledger.jsonl")).collect()] == ["gpt-4o"]
    (tmp_path / "golden.jsonl").write_text('# comment\n\n{"id": "g1", "expected": {"significance_score": {"min": 0.1, "max": 0.3}, "topic": "other"}}\n')
    assert [(r.id, r.expected.significance_score.max) for r in Land.read_golden(spark, str(tmp_path / "golden.jsonl")).collect()] == [("g1", 0.3)]


@pytest.mark.parametrize("seeded", [False, True])
def test_streamed_ingest_equals_the_batch_job(spark, tmp_path, seeded):
    log = random_log(60, 9)
    land = str(tmp_path / "in")
    # seeded: the first two batches are history from before the stream
    first, earlier = 0, None
    if seeded:
        before = observed(spark, [r for r in log if r[2] < 2])
        earlier = J.seen_versions(before.groupBy("source_url", "content_hash").agg(F.max(F.timestamp_micros(F.col("batch") * 1_000_000 + F.col("seq"))).alias("last_seen_at")))
        first = 2
    run = J.ingest_batch(str(tmp_path / "state"), str(tmp_path / "events"), buckets=4, earlier=earlier)
    for b in range(first, 6):
        observed(spark, [r for r in log if r[2] == b]).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(observed(spark, []).schema).parquet(land)
        J.each_batch(stream, run, str(tmp_path / "ck")).awaitTermination(120)
    run(observed(spark, [r for r in log if r[2] == 5]), 5 - first)  # replayed
    got = spark.read.parquet(str(tmp_path / "events")).collect()
    want = [r for r in sequential_outcomes(log) if r[4] != "unchanged" and r[2] >= first]
    assert sorted((r.source_url, r.content_hash, r.outcome) for r in got) == sorted((u, h, k) for u, h, _, _, k, _ in want)


def test_streamed_dedup_and_windows(spark, tmp_path):
    log = random_log(50, 4)
    observed(spark, log).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(observed(spark, []).schema).parquet(str(tmp_path / "in"))
    J.dedup_stream(stream, "30 days").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("deduped").count() == len({h for _, h, _, _ in log})
    blocks = stream.select(F.col("fetched_at").alias("ts"), F.col("source_url").alias("domain"))
    J.windowed_blocks(blocks, "1 day", "1 day").writeStream.format("memory").outputMode("complete").queryName("blocks").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("blocks").agg(F.sum("blocks")).first()[0] == len(log)


def test_tracked_versions_equal_the_batch_job(spark, tmp_path):
    log = random_log(60, 12)
    observed(spark, log).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(observed(spark, []).schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        J.track_versions(stream).writeStream.format("memory").outputMode("append").queryName("tracked").trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((tuple(r) for r in spark.table("tracked").select("source_url", "content_hash", "batch", "seq", "outcome", "prev_hash").collect()), key=str)
    assert got == sequential_outcomes(log)


def test_breaker_stream_counts_like_the_batch_job(spark, tmp_path):
    at = [0, 10, 20, 59, 60, 61, 400, 401, 402, 403]
    calls = spark.createDataFrame([("s", START + timedelta(seconds=x), True) for x in at], "scope string, ts timestamp, failed boolean")
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        J.breaker_stream(stream, 60, 4, 300).writeStream.format("memory").outputMode("append").queryName("breaker").trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.failures, r.open_until is not None) for r in spark.table("breaker").orderBy("ts").collect()]
    want = [r.failures for r in W.rolling_failures(calls, 60, 4).orderBy("ts").collect()]
    assert [n for n, _ in got] == want
    assert [o for _, o in got] == [False, False, False, True, True, True, False, False, False, True]


def test_alert_stream_makes_each_alert_once(spark, tmp_path):
    events = spark.createDataFrame([("e1", "other", 0.7, ["US"], ["CN"]), ("e2", "other", 0.2, [], [])], "event_id string, topic string, significance_score double, origin_countries array<string>, destination_countries array<string>")
    subs = spark.createDataFrame([(1, None, None, None, 0.1, None, True), (2, ["other"], None, None, 0.5, "steel", True)], "id long, topics array<string>, origins array<string>, destinations array<string>, min_significance double, keyword_query string, is_active boolean")
    texts = lambda e: e.select("event_id", F.lit("duty on steel").alias("text"))
    run = J.alert_batch(texts, subs, str(tmp_path / "alerts"))
    run(events, 0)
    run(events, 1)
    run(events, 1)
    got = spark.read.parquet(str(tmp_path / "alerts")).select("subscription_id", "event_id").collect()
    assert sorted(map(tuple, got)) == [(1, "e1"), (1, "e2"), (2, "e1")]
    assert spark.read.parquet(str(tmp_path / "alerts" / "batch=1")).count() == 0
    addressed = subs.withColumns({"user_email": F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@x.org")), "channel": F.when(F.col("id") == 1, "email").otherwise("none"), "channel_target": F.lit(None).cast("string")})
    J.alert_batch(texts, addressed, str(tmp_path / "again"), str(tmp_path / "outbox"))(events, 0)
    assert sorted((r.event_id, r.recipient) for r in spark.read.parquet(str(tmp_path / "outbox")).collect()) == [("e1", "u1@x.org"), ("e2", "u1@x.org")]


def test_streamed_ingest_keeps_what_the_filter_passes(spark, tmp_path):
    rule = "The importer shall comply with section 5 of this regulation and pay the penalty required by the act. " * 5
    rows = observed(spark, [("u", "h", 0, 0), ("v", "k", 0, 1)]).withColumn("raw_text", F.when(F.col("source_url") == "u", rule).otherwise("hello there"))
    J.ingest_batch(str(tmp_path / "state"), str(tmp_path / "events"), filtered=True)(rows.withColumn("title", F.lit("")), 0)
    assert [r.source_url for r in spark.read.parquet(str(tmp_path / "events")).collect()] == ["u"]


def test_domain_report_and_eval(spark):
    from regdelta.operators import jobs
    from regdelta.plans import base as B
    from regdelta.plans import derived as D
    from regdelta.plans import event_queries as Q

    sf = "/root/testdata/sf0.001"
    scored = B.scored(spark, sf)
    mentions = S.entity_mentions(scored)
    report = jobs.domain_report(D.observations(spark, sf), B.versions(spark, sf), scored, S.sync_entities(mentions), S.entity_links(mentions), Q._obligations(spark, sf)[0], "cbp.gov", F.timestamp_seconds(F.lit(D.START)))
    assert len(report) == 8 and all(len(df.columns) > 1 and df.count() >= 0 for df in report.values())
    assert report["documents"].agg(F.sum("docs")).first()[0] == D.observations(spark, sf).where("source_url like '%cbp.gov%'").count()
    golden = spark.createDataFrame([("g1", ((0.8, 1.0), "critical", "other", ["cn"], None, True))], "id string, expected struct<significance_score:struct<min:double,max:double>,change_type:string,topic:string,origin_countries:array<string>,trade_flow_direction:string,should_trigger_obligations:boolean>")
    body = '{"significance_score": 0.9, "change_type": "critical", "topic": "x", "origin_countries": ["China"], "compliance_summary": "s"}'
    results, metrics = jobs.run_eval(golden, spark.createDataFrame([("g1", body)], "id string, body string"))
    assert results.first().failures == [] and metrics.first().pass_rate == 1.0 and metrics.first().gate_accuracy == 1.0


def test_rendered_messages(spark):
    from regdelta.functions import render

    row = spark.createDataFrame([(0.9, "tax", None, ["US"], [], None, "https://x.org", "a < b", "the quote", 3)], "significance_score double, topic string, change_type string, origin_countries array<string>, destination_countries array<string>, matched_keywords array<string>, source_url string, summary string, quote string, span_start int")
    e = {c: F.col(c) for c in row.columns}
    text, html = row.select(render.render_text(e), render.render_html(e)).first()
    assert "Band: CRITICAL" in text and "Destination: —" in text and text.endswith("Citation (verified):\n> the quote")
    assert "a &lt; b" in html and '<blockquote class="verified">' in html
