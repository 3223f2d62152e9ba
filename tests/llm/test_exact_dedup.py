from collections import Counter

import numpy as np

from regdelta.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, lang string, keep_id string, fp string"


def brute(rows):
    ids, size = {}, Counter()
    for r in rows:
        t = r[1] or ""
        size[t] += 1
        ids[t] = max([x for x in (ids.get(t), r[0]) if x is not None], default=None)
    return sorted(((r[0], ids[r[1] or ""], size[r[1] or ""], r[0] == ids[r[1] or ""]) for r in rows), key=str)


ROWS = [
    (1, "a b", "en", "x", "y"),
    (2, "a b", None, None, None),
    (3, "a  b", "en", "", ""),
    (4, None, "en", "x", "y"),
    (5, "", None, "x", "y"),
    (None, "z", "en", "x", "y"),
    (6, "z", "en", "x", "y"),
    (7, "w" * 300_000, "en", "x", "y"),
    (8, "w" * 300_000, "en", "x", "y"),
    (9, "w" * 300_000 + "!", "en", "x", "y"),
    (8, "w" * 300_000, "en", "x", "y"),
    (10, "only", "en", "x", "y"),
]


def test_marks_nulls_ties_long_texts_and_clashing_columns(spark):
    got = X.exact_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(ROWS)


def test_light_fingerprints_take_the_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(X, "heavy_keys", lambda counts, key, total: counts.where("n >= 4").select(key))
    rows = [(i, f"text {i % 40}" if i % 3 else "hot", "en", "x", "y") for i in range(300)]
    got = X.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(rows)


def test_one_row_of_each_text_stays(spark):
    kept = X.without_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "keep_id", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 8, 9, 10]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.exact_duplicates(empty).count() == 0 and X.without_copies(empty).count() == 0


def test_filters_merge_without_loss(spark):
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63, 500)
    rows = [(int(x),) for x in np.r_[fps, fps[:100], fps[:20]]]
    got = {r.fp: r.n for r in X.repeated_fingerprints(spark.createDataFrame(rows, "fp long").repartition(7), len(rows)).collect()}
    assert got == {k: n for k, n in Counter(x for (x,) in rows).items() if n > 1}
