import hashlib
import math
import random
import re
import zlib

import pytest

from regdelta.llm import resampling as R

SCHEMA = "doc_id long, text string, weight string, rank string, score string"


def features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    rows = []
    for d in docs:
        n, fs = features(d[1])
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        rows.append([d[0], len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def some_docs(n, seed=1):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "e5", "東京", "x", "Straße"]
    gaps = [" ", ", ", "\n", "_", "-", "\x7f"]
    texts = ["".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.choice((0, 3, 19, 20, 21, 60)))) for _ in range(n)]
    return [(i, t, "x", "y", "z") for i, t in enumerate(texts)]


def result(spark, rows, target, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    return sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_the_definition_with_nulls_ties_and_repeats(spark):
    rows = some_docs(300) + [(None, "w " * 30, None, None, None), (7, None, "x", "", ""), (8, "", "x", "", ""), (9, "a b " * 20, None, None, None)] + [(5, "beta " * 40, "x", "y", "z")] * 70
    target = ["beta gamma beta", None, "", "Alpha e5"]
    assert result(spark, rows, target, percent=20) == brute(rows, target, percent=20)


def test_tables_without_rows(spark):
    rows = some_docs(50)
    assert result(spark, [], ["a"]) == []
    assert result(spark, rows, []) == brute(rows, [])
    assert all(r[4] is None for r in result(spark, rows[:10], ["a"]))


def test_long_texts_are_worked_off_in_pieces(monkeypatch):
    text = " ".join(str(i % 977) + "é" * (i % 5) for i in range(3000)) + " " + "w" * 500 + " end"
    want = sorted(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])
    for piece in (1, 7, 300, 10**6):
        monkeypatch.setattr(R, "PIECE", piece)
        parts = list(R.buckets(text))
        assert sum(n for n, _ in parts) == features(text)[0]
        assert sorted(b for _, bs in parts for b in bs.tolist()) == want


@pytest.mark.parametrize("pivots", [2, 24])
def test_quickselect_finds_every_place(spark, pivots):
    draw = random.Random(pivots)
    rows = [(draw.randrange(-3, 3), draw.randrange(4), i) for i in range(60)]
    keys = spark.createDataFrame(rows, "a long, b long, c long").repartition(3)
    for k in (1, 31, 60):
        assert R.kth_key(keys, ["a", "b", "c"], k, pivots) == sorted(rows)[k - 1]
    assert R.kth_key(keys, ["a", "b", "c"], 61, pivots) is None and R.kth_key(keys, ["a", "b", "c"], 0, pivots) is None


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(some_docs(200), SCHEMA)
    got = R.resampled_documents(docs, spark.createDataFrame([("beta",)], "text string"), percent=10)
    assert got.columns == docs.columns
    able = docs.where("size(regexp_extract_all(text, '[0-9A-Za-zé東京ßä]+', 0)) >= 20").count()
    assert 0 < got.count() <= able


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = R.op11_importance_resampling(spark, sf)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target)
