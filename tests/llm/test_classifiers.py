import zlib

import numpy as np
import pytest

from regdelta.llm import quality as Q
from regdelta.llm import toxicity as X

DOCS = "doc_id long, text string, label string, score string, body string"
LABELS = "doc_id long, quality int, toxic int, text string"
GOOD = ["river", "stone", "green", "bridge", "house", "garden", "morning", "letter", "window", "table", "winter", "paper"]


def rng_words(rng, n):
    return [GOOD[i] + GOOD[j][:2] for i, j in rng.integers(0, len(GOOD), (n, 2))]


def corpus(n=600):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(n):
        words = rng_words(rng, 60)
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 8 else [words[0]] * 60
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = ["vexer", "vexling", "grolt"][at % 3]
        docs.append((i, " ".join(words) + ".", "x", "y", "z"))
        labels.append((i, int(not bad), int(toxic), "clash"))
    return docs, labels


EXTRA = [
    (None, "river stone", None, None, None),
    (9000, None, "x", "y", "z"),
    (9001, "", "x", "y", "z"),
    (9002, "word " * 200_000, "x", "y", "z"),
    (3, "twice the same id", "", "", ""),
    (3, "twice the same id", "", "", ""),
]


@pytest.mark.parametrize("which,parts,left,field", [("quality", 4, 2, 1), ("toxic", 5, 0, 2)])
def test_held_out_accuracy_and_odd_rows(spark, which, parts, left, field):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs + EXTRA, DOCS)
    more = [(None, 1, 1, ""), (1, None, None, ""), (9100, 0, 1, ""), (9100, 1, 0, "")]
    known = spark.createDataFrame(labels + more, LABELS)
    got = (Q.score_quality if which == "quality" else X.score_toxicity)(frame, known).collect()
    assert len(got) == len(docs) + len(EXTRA)
    truth = {r[0]: r[field] for r in labels}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == left)
        assert r.predicted == int(r.score >= (0.7 if which == "quality" else 0.5))
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", ""), (2, None, "", "", "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in Q.score_quality(docs, none).collect()] == [0.5, 0.5]
    assert [r.score for r in X.score_toxicity(docs, none).collect()] == [0.0, 0.0]
    alike = spark.createDataFrame([(1, 1, 0, "")], LABELS)
    assert {r.predicted for r in Q.score_quality(docs, alike).collect()} <= {0, 1}
    empty = spark.createDataFrame([], DOCS)
    assert Q.score_quality(empty, none).count() == 0 and X.score_toxicity(empty, none).count() == 0


def test_good_documents_keep_their_columns(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs, DOCS)
    kept = Q.good_documents(frame, spark.createDataFrame(labels, LABELS))
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i in ids for i in range(300) if i % 4) > 200 and sum(i in ids for i in range(0, 300, 4)) < 10


def test_pairs_express_what_single_figures_cannot():
    """Exclusive or of two figures: no sum of tables of one figure tells the classes apart."""
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x, y, rounds=20, pair_rounds=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert ((Q.Additive(model.base, model.edges, model.mains, []).score(x) > 0.5) == y).mean() < 0.8


def test_the_corrected_risk_sees_through_unlabelled_positives():
    """A fifth of the unlabelled rows are positive; plain positive-against-rest weights would be torn."""
    rng = np.random.default_rng(3)
    n, prior = 4000, 0.2
    hidden = rng.random(n) < prior
    rows = lambda flag: (rng.random((len(flag), 6)) < np.where(flag[:, None], 0.7, 0.03)).astype(np.uint8)
    x = np.r_[rows(np.ones(800, bool)), rows(hidden)]
    w, b = X.fit_nnpu(x, np.r_[np.ones(800, bool), np.zeros(n, bool)], prior)
    assert (((x[800:] @ w + b) > 0) == hidden).mean() > 0.97


def test_quality_scores_are_sums_of_table_cells(spark):
    """Scores of the operator against a plain loop over the tables of a model fitted to the same rows."""
    docs, labels = corpus(240)
    learn = [(d, q) for d, q, _, _ in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    text = {d: t for d, t, *_ in docs}
    model = Q.fit(np.array([Q.figures(text[d]) for d, _ in learn]), np.array([float(q) for _, q in learn]))
    assert model.pairs

    def plain(t):
        x = Q.figures(t)
        at = [sum(1 for e in edges if e <= v) for edges, v in zip(model.edges, x)]
        total = model.base
        for j, cells in enumerate(model.mains):
            total += cells[at[j]]
        for i, j, ci, cj, cells in model.pairs:
            total += cells[ci[at[i]]][cj[at[j]]]
        return 1 / (1 + np.exp(-total))

    got = {r.doc_id: r.score for r in Q.scores(spark.createDataFrame(docs, DOCS), model).collect()}
    assert len(got) == 240 and all(abs(got[d] - plain(t)) < 1e-9 for d, t in text.items())
    # the operator fits the same rows; their order may differ by partition, and sums with it
    whole = {r.doc_id: r.score for r in Q.score_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(abs(whole[d] - plain(t)) < 1e-6 for d, t in text.items())


def test_toxicity_scores_are_sums_of_feature_weights(spark):
    """Features and weights of a trained model, summed by a plain loop over words and their beginnings."""
    docs, labels = corpus(400)
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    learn = X.fold(X.F.col("doc_id"), 5) != 0
    model = X.train(frame, known, learn)
    weight = dict(zip(model.features.tolist(), model.weights))

    def plain(t):
        words = set(X.WORD.findall(t.lower()))
        marks = {w + "$" for w in words} | {w[:k] for w in words for k in range(3, 8) if len(w) >= k}
        return 1 / (1 + np.exp(-(model.bias + sum(weight.get(X._hash(m), 0.0) for m in marks))))

    cache = X.WordCache(model.features)
    assert all(abs(model.score(cache, [t])[0] - plain(t)) < 1e-9 for _, t, *_ in docs)
    got = {r.doc_id: r for r in X.score_toxicity(frame, known).collect()}
    sides = [(r.score >= 0.5) == (plain(t) >= 0.5) for d, t, *_ in docs for r in [got[d]]]
    assert len(got) == 400 and sum(sides) / len(sides) > 0.99


def test_features_are_those_that_a_plain_count_would_choose(spark):
    docs, labels = corpus(400)
    learn = {d for d, *_ in docs if zlib.crc32(str(d).encode()) % 5 != 0}
    toxic = {d for d, _, t, _ in labels if t and d in learn}
    prior = len(toxic) / len(learn)
    count: dict[str, list[int]] = {}
    for d, t, *_ in docs:
        if d in learn:
            words = set(X.WORD.findall(t.lower()))
            for m in {w + "$" for w in words} | {w[:k] for w in words for k in range(3, 8) if len(w) >= k}:
                count.setdefault(m, [0, 0])[d not in toxic] += 1
    p, u = len(toxic), len(learn) - len(toxic)
    want = set()
    for m, (a, b) in count.items():
        spread = ((a + b) / (p + u) * (1 / p + 1 / u)) ** 0.5
        if a >= 3 and prior * (a / p) / ((b + 0.5) / (u + 1)) >= 0.35 and (a / p - b / u) / spread >= 4:
            want.add(X._hash(m))
    model = X.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), X.fold(X.F.col("doc_id"), 5) != 0)
    assert set(model.features.tolist()) == want and 0 < len(want) < X.FEATURES


def test_an_id_or_url_on_very_many_rows_is_fitted_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from regdelta.llm import url_filter as U

    n = 20_000
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text number ', id) AS text").unionByName(spark.range(n).selectExpr("5L AS doc_id", "concat('again ', id % 3) AS text"))
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "CAST(id % 2 AS INT) AS toxic")
    fitted = []
    real = Q.fit
    monkeypatch.setattr(Q, "fit", lambda x, y: fitted.append(len(y)) or real(x, y))
    Q.train(docs, labels, F.lit(True))
    monkeypatch.setattr(X, "fit_nnpu", lambda x, positive, prior: fitted.append(len(positive)) or (np.zeros(x.shape[1]), 0.0))
    X.train(docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit(" vile"))).otherwise(F.col("text"))), labels, F.lit(True))
    assert fitted[0] == 200 and fitted[1:] in ([], [200])
    pages = spark.range(n).selectExpr("id AS page_id", "'http://example.org/es/a' AS url").unionByName(spark.range(40).selectExpr("id AS page_id", "concat('http://a', id, if(id % 2 = 0, '.com/fr/', '.com/de/')) AS url"))
    rows = []
    monkeypatch.setattr(U, "cut", lambda df, label, real=U.cut: (lambda out: rows.append((label, out.count())) or out)(real(df, label)))
    U.judge_urls(pages, rounds=1).count()
    assert dict(rows)["url-fit"] == 41
