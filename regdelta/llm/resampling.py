"""Importance resampling towards a target: hashed n-gram weights, Gumbel scores, a distributed quickselect.

The weight of a document is the sum of the log ratios of target and corpus frequencies of the buckets that its
features fall in. With Gumbel noise from a hash of the id, the documents of highest score are a sample without
replacement by weight. The k-th score is found by quickselect: pivots drawn from the keys that are left, exact counts below,
at and above each of them, on and on in the one gap that holds the k-th key. Winners alone are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, python_tasks, table
from regdelta.operators.ranks import numbered

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of a text whose features are held at once.
PIECE = 1 << 20
#: Pivots of a round of the quickselect; a round leaves about one in so many keys.
PIVOTS = 24

#: A-Z become a-z; bytes that belong to no word become blanks. Bytes from 0x80 on belong to letters beyond ASCII.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about PIECE bytes; a list starts with the last LONGEST_RUN - 1 words of the one before."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)
    if len(data) <= PIECE:
        yield data.split()
        return
    at, last = 0, []
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = last + data[at:end].split()
        yield words
        last, at = words[-(LONGEST_RUN - 1) :], end


def _features(words: list[bytes], known: int) -> np.ndarray:
    """Buckets of the runs of words that end after the first `known` of them."""
    crc, out = zlib.crc32, []
    begun = [0] * len(words)
    spaced = words
    for length in range(1, LONGEST_RUN + 1):
        # the checksum of a run goes on from that of the run without its last word
        begun = list(map(crc, spaced[length - 1 :], begun))
        out.append(begun[max(0, known - length + 1) :])
        if length == 1:
            spaced = [b" " + w for w in words]
    return np.array([c for part in out for c in part], np.int64) % BUCKETS


def buckets(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of features) of the pieces of a text; every feature is in one of them."""
    known = 0
    for words in _pieces(text):
        yield len(words) - known, _features(words, known)
        known = min(len(words), LONGEST_RUN - 1)


def _count_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch["text"]:
            for _, b in buckets(text):
                total += np.bincount(b, minlength=BUCKETS)
    there = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": there.astype(np.int32), "n": total[there]})


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket: one figure a bucket reaches the driver, however many the texts."""
    python_tasks(texts.sparkSession)
    counts = texts.select(F.col(text_col).alias("text")).mapInPandas(_count_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counts["bucket"]] = counts["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(gains: np.ndarray):
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch["text"]:
                w = f = total = 0
                for words, b in buckets(text):
                    w, f, total = w + words, f + len(b), total + int(gains[b].sum())
                n_words.append(w)
                n_features.append(f)
                weight.append(total)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n_words, "n_features": n_features, "weight": weight})

    return weigh


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the hash of seed and id; a null id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth_key(keys: DataFrame, columns: list[str], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th least (k from 1) of the distinct rows of keys, compared column by column; None if there are fewer.

    columns are longs without nulls. Each round draws pivots by a hash of the keys that are left, counts exactly how many keys
    lie below each pivot, at it and above the last, and keeps the gap that holds the k-th. At most `pivots` keys and twice as many
    counts a round reach the driver. What is left is written anew each round: a small part of what was there.
    """
    if k < 1:
        return None
    left, turn = keys.select(*columns), 0
    while True:
        turn += 1
        drawn = sorted(tuple(r) for r in left.orderBy(F.xxhash64(F.lit(turn), *columns)).limit(pivots).collect())
        if not drawn:
            return None
        below, at = F.lit(0), F.lit(0)
        for p in drawn:
            more, same = F.lit(False), F.lit(True)
            for c, v in zip(columns, p):
                more, same = more | (same & (F.col(c) > F.lit(v))), same & (F.col(c) == F.lit(v))
            below, at = below + more.cast("int"), at + same.cast("int")
        # an even part is the gap below pivot part / 2, an odd one that pivot itself
        parted = left.withColumn("_part", 2 * below + at)
        counts = {r["_part"]: r["n"] for r in parted.groupBy("_part").agg(F.count("*").alias("n")).collect()}
        for part in range(2 * len(drawn) + 1):
            n = counts.get(part, 0)
            if k <= n:
                break
            k -= n
        else:
            return None
        if part % 2:
            return drawn[part // 2]
        left = cut(parted.where(F.col("_part") == part).drop("_part"), "left")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; rank is null where the row is not drawn.

    target: texts (text_col) that the sample should look like. Of the N rows with least_words words or more, the floor(percent N /
    100) of highest score are drawn; ties go to the smaller id, a null id last, then to the row with fewer features. Rows that repeat an id are
    drawn like others: rows alike in all of this are told apart by their place in the table of scores, so that the
    number drawn is exact. Null and empty texts have no features and weight 0. Texts are worked off in pieces, so a very long one
    needs no more memory than its own text. An empty table gives an empty result; an empty target counts as one without features.
    Other columns are not read.
    """
    python_tasks(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weighed = texts.mapInPandas(_weigh(gains), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id())
    scored = cut(scored, "scores")
    key = {"_a": -F.col("score"), "_b": F.col("doc_id").isNull().cast("long"), "_c": F.coalesce("doc_id", F.lit(0)), "_d": F.col("n_features"), "_e": F.col("_row")}
    able = F.col("n_words") >= least_words
    keyed = scored.where(able).select(*[c.alias(n) for n, c in key.items()])
    edge = kth_key(keyed, list(key), keyed.count() * percent // 100)
    named = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if edge is None:
        return scored.select(*named, none)
    drawn = F.lit(True)
    for c, v in reversed(list(zip(key.values(), edge))):
        drawn = (c < F.lit(v)) | ((c == F.lit(v)) & drawn)
    ranked = numbered(scored.where(able & drawn), list(key.values()), "rank", named)
    return ranked.select(*named, F.col("rank").cast("long")).unionByName(scored.where(~(able & drawn)).select(*named, none))


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id is drawn, all their columns. Options as of `resample`."""
    id_col = options.get("id_col", "doc_id")
    drawn = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, F.col(id_col).cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")
