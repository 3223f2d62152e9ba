import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from regdelta.llm import bpe, common, decontaminate, quality, simhash
from regdelta.llm.exact_dedup import without_copies

SF = "/root/testdata/sf0.001"


def plain_kept(rows, good, items):
    """The stages in plain Python; rows: (doc_id, text)."""
    rows = [r for r in rows if r[0] in good]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    rows = [(i, t) for i, t in rows if last[t] == i]
    f = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    best = np.array([i for i, _ in rows])
    while True:
        new = np.array([best[x].min() for x in near])
        if (new == best).all():
            break
        best = new
    rows = [r for r, b in zip(rows, best) if r[0] == b]
    words = lambda t: " " + " ".join(x.lower() for x in decontaminate.TOKEN.findall(t) if x not in ".!?\n") + " "
    return [(i, t) for i, t in rows if not any(words(x) in words(t) for x in items)]


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.op3_quality(spark, SF).collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain_kept([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id for r in scored if r.predicted}, items)
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert sorted(got) == sorted(i for i, _ in want) and len(want) > 100
    for i, t in want:
        ids = enc.encode_ordinary(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key string"


#: Ids of the rows below that a stage keeps.
STAY = {"exact_dedup": [2, 3, 4, None], "near_dedup": [1, 3, 4, None], "decontaminate": [1, 2, 3, 3, 4, None]}


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, name, stage):
    rows = [
        (1, None, None, None, None, None, None),
        (None, "some words here", None, None, None, "x", "y"),
        (2, "", "en", "s", 0, "x", "y"),
        (3, "w " * 100_000, "en", "s", 1, "x", "y"),
        (3, "w " * 100_000, "en", "s", 1, "x", "y"),
        (4, "a sentence that stands alone here", "en", "s", 1, "x", "y"),
    ]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count()
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name in STAY and not docs.isEmpty():
            assert sorted((r.doc_id for r in out.collect()), key=str) == STAY[name]


def test_rows_that_tie_and_more_rows_than_are_broadcast(spark, monkeypatch):
    """Null ids, an id on two texts and rows that repeat, with the rows that go joined by Spark."""
    monkeypatch.setattr(common, "BROADCAST_GOING", 0)
    a, b = "one two three four five six seven eight", "quite another line of words that shares nothing with it"
    rows = [(None, a), (None, a), (None, b), (5, a), (5, b), (5, b), (6, b), (7, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in rows], SCHEMA)
    exact = [(r.doc_id, r.text) for r in without_copies(docs).collect()]
    assert sorted(exact, key=str) == [(5, a), (7, b)]
    near = [(r.doc_id, r.text) for r in simhash.without_near_copies(docs).collect()]
    assert sorted(near, key=str) == [(5, a), (5, b)]
    nulls = [(r.doc_id, r.text) for r in simhash.without_near_copies(docs.where("doc_id is null")).collect()]
    assert sorted(nulls, key=str) == [(None, a), (None, b)]
