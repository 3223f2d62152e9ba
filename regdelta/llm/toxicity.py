"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive set; all other text, labelled or not, is the
unlabelled set, which holds toxic text too. The class prior is the share of toxic
labels. Features are the words of a text and the beginnings of words; those are kept
whose estimated purity, prior times their share of positive texts over their share of
unlabelled ones, is high and beyond chance. A numpy classifier is then trained on the
prior-corrected risk: prior * positive loss + max(0, unlabelled loss - prior * positives'
loss as negatives). Where the second part falls below zero, the step goes the other way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, fold, hash_edge, labelled_ids, python_tasks, table

#: About so many confirmed toxic texts, and so many other ones, are fitted at most.
FIT_TOXIC = 8_000
FIT_UNLABELLED = 16_000
#: Most features of the model.
FEATURES = 768
BEGINNINGS = (3, 4, 5, 6, 7)
WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}']*")


def _hash(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) - (1 << 63)


def word_features(word: str) -> list[int]:
    """A word and its beginnings, marked apart, as hashes."""
    return [_hash(word + "$"), *(_hash(word[:k]) for k in BEGINNINGS if len(word) >= k)]


class WordCache:
    """Features of words met lately, kept to those of the model; a bounded dictionary."""

    def __init__(self, kept: np.ndarray | None, most: int = 1 << 18):
        self.at = None if kept is None else {int(h): i for i, h in enumerate(kept)}
        self.most, self.known = most, {}

    def __call__(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            got = word_features(word)
            got = tuple(got) if self.at is None else tuple(self.at[h] for h in got if h in self.at)
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = got
        return got

    def of_text(self, text: str) -> set[int]:
        found: set[int] = set()
        for w in set(WORD.findall(text.lower())):
            got = self(w)
            if got:
                found.update(got)
        return found


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of a task: number of positive and of unlabelled texts that have it."""
    keys, pos, all_ = np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    cache = WordCache(None)

    def merged(parts):
        k, p, a = (np.concatenate(x) for x in zip(*parts))
        k, back = np.unique(k, return_inverse=True)
        return k, np.bincount(back, p, len(k)).astype(np.int64), np.bincount(back, a, len(k)).astype(np.int64)

    def out(k, p, a):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(p), pa.array(a - p)], ["f", "pos", "unl"])

    waiting, held = [(keys, pos, all_)], 0
    for b in batches:
        for label, text in zip(b.column("label").to_pylist(), b.column("body").to_pylist()):
            got = np.fromiter(cache.of_text(text or ""), np.int64)
            waiting.append((got, np.full(len(got), label), np.ones(len(got), np.int64)))
            held += len(got)
            if held > 1 << 20:
                waiting, held = [merged(waiting)], 0
                if len(waiting[0][0]) > 1 << 21:
                    yield out(*waiting[0])
                    waiting = [(keys, pos, all_)]
    yield out(*merged(waiting))


class Classifier:
    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def score(self, cache: WordCache, texts: list[str]) -> np.ndarray:
        z = np.array([self.bias + self.weights[list(got)].sum() if (got := cache.of_text(t)) else self.bias for t in texts])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk with the sigmoid loss; Adam steps on mixed batches."""
    rng = np.random.default_rng(seed)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    w, b = np.full(x.shape[1], 0.05), -1.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    batches = max(1, len(u) // 1024)
    for _ in range(epochs):
        for pi, ui in zip(np.array_split(rng.permutation(p), batches), np.array_split(rng.permutation(u), batches)):
            if not len(pi) or not len(ui):
                continue
            xp, xu = x[pi].astype(np.float32), x[ui].astype(np.float32)
            sp, su = (1 / (1 + np.exp(-np.clip(q @ w + b, -30, 30))) for q in (xp, xu))
            # sigmoid loss: as positive 1 - s, as negative s
            negative = su.mean() - prior * sp.mean()
            dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
            up = -prior * np.r_[dp @ xp, dp.sum()]
            down = np.r_[du @ xu, du.sum()] - prior * np.r_[dp @ xp, dp.sum()]
            grad = up + down if negative >= 0 else -down
            grad[:-1] += decay * w
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, learn, most_toxic: int = FIT_TOXIC, most_unlabelled: int = FIT_UNLABELLED) -> Classifier | None:
    """None if there is no confirmed toxic text or nothing else."""
    known = labels.where(learn & F.col("toxic").isNotNull())
    got = known.agg(F.count("*").alias("n"), F.sum(F.col("toxic")).alias("toxic")).first()
    if not got["n"] or not got["toxic"]:
        return None
    prior = min(0.9, got["toxic"] / got["n"])
    toxic = labelled_ids(labels, "toxic", learn, 2**62).where("label = 1").select("doc_id")
    toxic = cut(toxic.where(F.xxhash64("doc_id") <= F.lit(hash_edge(got["toxic"], most_toxic))), "toxic-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body")).where(learn)
    edge = hash_edge(rows.agg(F.approx_count_distinct("doc_id")).first()[0], most_unlabelled)
    # about most_toxic numbers: small whatever the input
    positive = rows.join(F.broadcast(toxic), "doc_id").select("doc_id", F.lit(1).alias("label"), "body")
    others = rows.where(F.xxhash64("doc_id", F.lit(1)) <= F.lit(edge)).join(F.broadcast(toxic), "doc_id", "left_anti")
    drawn = positive.unionByName(others.select("doc_id", F.lit(0).alias("label"), "body"))
    # an id counts once, with its text of least hash, however many rows repeat it
    sample = cut(drawn.groupBy("doc_id", "label").agg(F.min_by("body", F.xxhash64("body")).alias("body")).select("label", "body"), "toxic-fit")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, u = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not u:
        return None
    counted = sample.mapInArrow(_frequencies, "f long, pos long, unl long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    in_pos, in_unl = F.col("pos") / p, (F.col("unl") + 0.5) / (u + 1)
    spread = F.sqrt((F.col("pos") + F.col("unl")) / (p + u) * (1.0 / p + 1.0 / u))
    chosen = (
        counted.where(F.col("pos") >= 3)
        .withColumn("purity", prior * in_pos / in_unl)
        .withColumn("beyond", (in_pos - F.col("unl") / u) / spread)
        .where("purity >= 0.35 and beyond >= 4")
        .orderBy(F.desc("beyond"), "f")
        .limit(FEATURES)
    )
    features = np.array(sorted(r["f"] for r in chosen.select("f").collect()), np.int64)
    if not len(features):
        return None
    held = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(held.value)
        for b in batches:
            got = [sorted(cache.of_text(t or "")) for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(got, pa.list_(pa.int32()))], ["label", "x"])

    got = sample.mapInArrow(run, "label int, x array<int>").toPandas()
    x = np.zeros((len(got), len(features)), np.uint8)
    at = np.repeat(np.arange(len(got)), got["x"].map(len))
    x[at, np.concatenate(got["x"].to_list()).astype(np.int64)] = 1
    weights, bias = fit_nnpu(x, got["label"].to_numpy() == 1, prior)
    return Classifier(features, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_toxic: int = FIT_TOXIC, fit_unlabelled: int = FIT_UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Learns from ids whose fold (crc32 of the id as text, modulo 5) is not 0: from their
    texts, and from labels.toxic where that is 1; zeros only enter the class prior. Null
    labels and ids are not learned from, nor ids labelled both ways. Null counts as an
    empty text; empty texts are scored like others and have no feature. Where nothing can be
    learned every score is 0. A null id is scored and not held out; repeated rows score alike;
    an empty input gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, fold(F.col("doc_id"), 5) != 0, fit_toxic, fit_unlabelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        cache = WordCache(m.features) if m else None
        for b in batches:
            texts = [t or "" for t in b.column("body").to_pylist()]
            got = m.score(cache, texts) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
