import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from regdelta.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, target string"


def brute(rows, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for r in rows:
        total[r[2]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), share * sum(total.values())
    while True:
        rest = [s for s in names if s not in full]
        given = left - sum(most * total[s] for s in full)
        want = {s: given * weigh[s] / sum(weigh[x] for x in rest) for s in rest}
        over = {s for s in rest if want[s] > most * total[s]}
        if not over:
            break
        full |= over
    target = {s: float(want.get(s, most * total[s])) for s in names}
    out = []
    for s in names:
        own = sorted((size(r[1]), r[0] is not None, r[0] or 0) for r in rows if r[2] == s)
        rate = target[s] / total[s] if total[s] else 0.0
        u = int(hashlib.sha256(f"42:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        f = rate - math.floor(rate)
        for i, (n, there, x) in enumerate(own):
            copies = math.floor(rate) + math.floor(u + f * (i + 1)) - math.floor(u + f * i)
            out.append((x if there else None, n, total[s], round(target[s], 6), n * copies))
    return sorted(out, key=str)


def some_docs(n, seed=2):
    draw = random.Random(seed)
    names = ["hot"] * 4 + ["B", "a", "é", None, "z", "empty"]
    rows = []
    for i in range(n):
        s = draw.choice(names)
        words = 0 if s == "empty" else draw.choice((0, 1, 3, 40, 700))
        rows.append((i, None if draw.random() < 0.05 else " w\t " * words, s, "x", None))
    return rows


def result(spark, rows, **options):
    got = M.mix(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()), key=str)


def test_equals_the_definition_with_nulls_ties_and_repeats(spark):
    rows = some_docs(300) + [(None, "a b", "hot", "", ""), (5, "", None, "", "")] + [(1, "a b c", "B", "", "")] * 40
    assert result(spark, rows) == brute(rows)


def test_excess_is_reshared_over_several_rounds(spark):
    rows = [(i * 10 + j, "w " * n, chr(97 + i), None, None) for i, n in enumerate((1, 2, 4, 8, 16, 900)) for j in range(3)]
    assert result(spark, rows) == brute(rows)


def test_sums_come_near_and_reruns_agree(spark):
    rows = some_docs(900, 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = M.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, M.mix(docs.repartition(9)).collect()))
    taken, most, target = Counter(), Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)


def test_no_rows_no_words_and_wrong_shares(spark):
    assert result(spark, []) == []
    assert [r[2:] for r in result(spark, [(1, None, "a", "", ""), (2, " ", None, "", "")])] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        M.mix(spark.createDataFrame([], SCHEMA), share=2.5)


def test_documents_are_emitted_as_often_as_drawn(spark):
    rows = some_docs(200) + [(7, "one two", "B", "p", "q")] * 9
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = Counter()
    for r in M.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert +words == +want


def test_sql_states_the_same(spark):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(M.OP13_SQL).df().sort_values("doc_id")
    got = M.op13_source_mix(spark, sf).toPandas().sort_values("doc_id")
    assert got[sorted(got)].values.tolist() == want[sorted(want)].values.tolist()
