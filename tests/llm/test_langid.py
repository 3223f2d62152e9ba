import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from regdelta.llm import langid as L
from regdelta.llm.common import least_count

SCHEMA = "doc_id long, text string, lang string, score string, held_out string"


def plain_model(texts):
    """Interpolated Kneser-Ney with dictionaries, straight from the definition."""
    counts = Counter()
    for t in texts:
        s = "\x01\x01\x01" + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "
        for i in range(3, len(s)):
            counts[s[i - 3 : i + 1]] += 1
    orders = {4: counts}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    return orders


def plain_prob(orders, gram, size):
    k = len(gram)
    if not k:
        return 1 / size
    c = orders[k]
    n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
    total = sum(v for g, v in c.items() if g[:-1] == gram[:-1])
    below = plain_prob(orders, gram[1:], size)
    if not total:
        return below
    kinds = sum(g[:-1] == gram[:-1] for g in c)
    return max(c[gram] - d, 0) / total + d * kinds / total * below


def test_probabilities_are_those_of_the_definition(spark):
    texts = {"aa": ["the cat sat, on the mat!", "a cat"], "bb": ["der hund und die katze", "Öl und hund"]}
    rows = [(k, t) for k, ts in texts.items() for t in ts]
    m = L.train(spark.createDataFrame(rows, "lang string, body string"))
    size = len({c for ts in texts.values() for t in ts for c in plain_model([t])[1]}) + 1
    for gram in ["the ", " cat", "und ", "xyz ", "\x01\x01\x01t", "hund", "q   "[:4], "atze"]:
        got = m.log_prob(np.array([[ord(c) for c in gram]], np.uint32))[0]
        for i, lang in enumerate(m.langs):
            assert math.isclose(math.exp(got[i]), plain_prob(plain_model(texts[lang]), gram, size), rel_tol=1e-4), (gram, lang)


def corpus():
    syllables = {"aa": ["ka", "to", "mi", "nu", "ra"], "bb": ["sch", "ich", "ung", "ver", "en"]}
    rows = []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        words = itertools.islice(itertools.cycle(syllables[lang]), i % 7, i % 7 + 30)
        rows.append((i, " ".join(w + x for w, x in zip(words, syllables[lang] * 6)) + "." * (i % 3), lang, "", ""))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    extra = [
        (1000, None, "aa", "", ""),
        (1001, "", "bb", "", ""),
        (1002, "12 - !!", None, None, None),
        (None, "ka to mi", "aa", "", ""),
        (1003, "schich " * 300_000, None, "", ""),
        (5, "ka to", "aa", "", ""),
        (5, "ka to", "aa", "", ""),
    ]
    rows = corpus() + extra
    got = L.identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in corpus()}
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert [by_id[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1003][0].lang_pred == "bb" and by_id[None][0].lang_pred == "aa"


def test_predictions_are_those_of_the_definition(spark):
    """Least cross-entropy a symbol, worked out with dictionaries, the first language by name on a tie."""
    rows = corpus()[:60] + [(900 + i, t, None, "", "") for i, t in enumerate(["ver ich", "kato mi", "xx yy zz", "ka ung", "ra ra RA!", "e"])]
    got = {r.doc_id: r for r in L.identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    learned = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2 and zlib.crc32(str(r[0]).encode()) % 64 != 3]
    models = {x: plain_model([r[1] for r in learned if r[2] == x]) for x in ("aa", "bb")}
    size = len({g for m in models.values() for g in m[1]}) + 1
    for i, text, *_ in rows:
        s = "\x01\x01\x01" + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        grams = Counter(s[k - 3 : k + 1] for k in range(3, len(s)))
        entropy = {x: -sum(n * math.log(plain_prob(m, g, size)) for g, n in grams.items()) / (len(s) - 3) for x, m in models.items()}
        assert got[i].lang_pred == min(entropy, key=lambda x: (round(entropy[x], 6), x))
        assert math.isclose(got[i].cross_entropy, min(entropy.values()), rel_tol=1e-4)


def test_long_texts_are_summed_over_portions(spark, monkeypatch):
    m = L.train(spark.createDataFrame([("aa", "ka to mi nu"), ("bb", "ver ung ich")], "lang string, body string"))
    texts = ["ka to mi " * 40, "", "ich", "ver ung" * 30]
    whole, size = m.cross_entropy(texts)
    monkeypatch.setattr(L, "SYMBOLS", 64)
    parts, again = m.cross_entropy(texts)
    assert np.allclose(whole, parts, rtol=1e-5) and (size == again).all()


def test_nothing_to_learn(spark):
    assert L.identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = L.identify_languages(spark.createDataFrame([(1, "abc", None, "", "")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def test_a_model_larger_than_the_broadcast_gives_the_same(spark, monkeypatch):
    """A language of few texts beside one of many: its grams are the first that a cap by count would drop."""
    rare = [(5000 + i, "zu qo xe " * (1 + i % 3) + "qoxe", "cc", "", "") for i in range(24)]
    odd = [(6000, None, "aa", "", ""), (6001, "", None, "", ""), (None, "qoxe zu", None, "", ""), (7, "ka to", "aa", "", ""), (7, "ka to", "aa", "", ""), (6002, "жук ~ wxyz", None, "", "")]
    docs = spark.createDataFrame(corpus() + rare + odd, SCHEMA)
    results = lambda: sorted(L.identify_languages(docs).collect(), key=lambda r: (str(r.doc_id), r.lang_pred, r.cross_entropy or 0))
    whole = results()
    for most in (60, 0):
        monkeypatch.setattr(L, "MAX_GRAMS", most)
        got = results()
        assert len(got) == len(whole)
        for a, b in zip(got, whole):
            assert (a.doc_id, a.held_out, a.lang_pred, a.rejected) == (b.doc_id, b.held_out, b.lang_pred, b.rejected)
            assert math.isclose(a.score, b.score, abs_tol=1e-3)
            assert a.cross_entropy == b.cross_entropy or math.isclose(a.cross_entropy, b.cross_entropy, rel_tol=1e-4)


def test_least_count_of_very_many_counts(spark):
    counted = spark.range(1, (1 << 17) + 1).withColumnRenamed("id", "n")
    assert least_count(counted, 100_000) == (1 << 17) - 100_000 + 1
    assert least_count(counted, 0) == (1 << 17) + 1
