"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes some thirty figures. Cyclic boosting goes round the figures, fits a
shallow tree of one figure to the gradient each time and adds it to that figure's lookup
table; then, for the pairs of figures that explain most of what is left, trees of two
figures go to tables of two indices. A score is the sum of the tables at a text's bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import fold, labelled_ids, python_tasks, table, tidy

#: About so many labelled documents are fitted at most.
FIT_ROWS = 30_000
THRESHOLD = 0.7
FIGURES = (
    "log_chars log_words log_lines word_length longest_word upper digit punctuation symbol blank non_ascii entropy "
    "distinct_words top_word same_next same_line line_length short_lines ended_lines no_letter exclaimed upper_words "
    "tailed_words bar_words short_words capitalised sentences"
).split()
SYMBOLS = set("%$#*&@|^~=<>_\\{}[]+")
ENDS = (".", "!", "?", ":", ";", '"', "”", "…", "。")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Code point to: 0 other letter, 1 upper-case, 2 digit, 3 punctuation, 4 symbol, 5 blank."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = 1 if s.isupper() else 0
        elif s.isspace():
            out[c] = 5
        elif s.isnumeric():
            out[c] = 2
        elif s in SYMBOLS:
            out[c] = 4
    return out


def figures(text: str) -> list[float]:
    """The figures of one whole text; all of them are zero for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(FIGURES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(classes()[points], minlength=6) / n
    share = np.bincount(np.minimum(points, 1023), minlength=1024)
    share = share[share > 0] / n
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    k = max(1, len(lines))
    letters = kinds[0] + kinds[1]
    bare = [w for w in words if not any(map(str.isalpha, w))]
    tailed = sum(1 for w in words if len(w) > 2 and not w[-1].isalnum() and w[-1] == w[-2])
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        sum(map(len, words)) / m,
        np.log1p(max(map(len, words), default=0)),
        kinds[1] / letters if letters else 0.0,
        kinds[2],
        kinds[3],
        kinds[4],
        kinds[5],
        float((points > 127).sum()) / n,
        float(-(share * np.log2(share)).sum()),
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        1 - len(set(lines)) / k,
        np.log1p(n / k),
        sum(len(x) < 40 for x in lines) / k,
        sum(x.endswith(ENDS) for x in lines) / k,
        len(bare) / m,
        text.count("!!") / m,
        sum(map(str.isupper, words)) / m,
        tailed / m,
        counts.get("|", 0) / m,
        sum(len(w) <= 3 for w in words) / m,
        sum(map(str.istitle, words)) / m,
        text.count(". ") / m,
    ]


@dataclass
class Additive:
    """edges: of the bins of each figure; mains: table of each figure; pairs: (i, j, bins of i, bins of j, table)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    mains: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: vectorised additions of the tables at the bins."""
        out = np.full(len(x), self.base)
        if self.edges:
            b = self.bins(x)
            for j, t in enumerate(self.mains):
                out += t[b[:, j]]
            for i, j, ci, cj, t in self.pairs:
                out += t[ci[b[:, i]], cj[b[:, j]]]
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def _tree_of_one(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float, least: float) -> np.ndarray:
    """Leaf values by bin: a tree of at most `leaves` leaves over the ordered bins, grown at its best cut."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-6, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + smooth)
            gain[(hl < least) | (hr < least)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], int(m[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def _tree_of_two(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts once along either axis."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def corners(c):
        a = c[1:-1, 1:-1]
        return a, c[1:-1, -1:] - a, c[-1:, 1:-1] - a, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + a

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    parts = list(zip(corners(cg), corners(ch)))
    gain = sum(a**2 / (b + smooth) for a, b in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [a[i, j] / (b[i, j] + smooth) for a, b in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, most_bins: int = 48, coarse: int = 12, rate: float = 0.12) -> Additive:
    """Boosts the tables; with one class alone, or no rows, the model is a constant."""
    n = len(y)
    if not n:
        return Additive()
    share = (y.sum() + 0.5) / (n + 1)
    model = Additive(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.mains = [np.zeros(s) for s in sizes]
    out = np.full(n, model.base)
    least, smooth = max(1.0, 0.0005 * n), 5.0
    for _ in range(rounds):
        for j, s in enumerate(sizes):
            if s < 2:
                continue
            p = 1 / (1 + np.exp(-out))
            step = rate * _tree_of_one(np.bincount(b[:, j], y - p, s), np.bincount(b[:, j], p * (1 - p), s), 4, smooth, least)
            model.mains[j] += step
            out += step[b[:, j]]
    groups = [np.arange(s) * min(s, coarse) // s for s in sizes]
    widths = [int(c[-1]) + 1 for c in groups]
    p = 1 / (1 + np.exp(-out))
    ranked = []
    for i in range(len(sizes)):
        for j in range(i):
            cell = groups[i][b[:, i]] * widths[j] + groups[j][b[:, j]]
            shape = (widths[i], widths[j])
            g, h = np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
            ranked.append((_tree_of_two(g, h, smooth)[0], i, j, cell, shape))
            ranked = sorted(ranked, key=lambda r: -r[0])[:pairs]
    tables = [np.zeros(r[4]) for r in ranked]
    for _ in range(pair_rounds):
        for t, (_, _, _, cell, shape) in zip(tables, ranked):
            p = 1 / (1 + np.exp(-out))
            size = shape[0] * shape[1]
            step = rate * _tree_of_two(np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape), smooth)[1]
            t += step
            out += step.ravel()[cell]
    model.pairs = [(i, j, groups[i], groups[j], t) for t, (_, i, j, _, _) in zip(tables, ranked)]
    return model


def train(docs: DataFrame, labels: DataFrame, learn, most: int = FIT_ROWS) -> Additive:
    """Fits about `most` labelled documents; their figures are worked out on the executors. An id counts once, with its text of least hash, however many rows repeat it."""
    ids = labelled_ids(labels, "quality", learn, most)
    # about `most` rows of two numbers: small whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body"), F.xxhash64("text").alias("hash")).join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [figures(t or "") for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), b.column("label"), pa.array(got, pa.list_(pa.float64()))], ["doc_id", "hash", "label", "x"])

    figured = rows.select("doc_id", "hash", "label", "body").mapInArrow(tidy(run), "doc_id long, hash long, label int, x array<double>")
    got = figured.groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), "hash").alias("r")).select("r.*").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FIGURES))), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), (got["label"].to_numpy() > 0).astype(float))


def scores(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    python_tasks(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([figures(t or "") for t in b.column("body").to_pylist()]).reshape(b.num_rows, len(FIGURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.score(x))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(tidy(run), "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Learns labels.quality of ids whose fold (crc32 of the id as text, modulo 4) is not 2;
    null labels and ids are not learned from, nor ids labelled both ways. Null counts
    as an empty text, and empty texts are scored like others. Without labels, or with
    one class alone, every score is the (smoothed) share of label 1, 0.5 without any.
    A null id is scored and not held out; repeated rows score alike; an empty input gives an
    empty result. Other columns are not read.
    """
    python_tasks(docs.sparkSession)
    model = train(docs, labels, fold(F.col("doc_id"), 4) != 2, fit_rows)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, all their columns; no join, the score is put beside the row."""
    python_tasks(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold(F.col("doc_id"), 4) != 2, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([figures(t or "") for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(FIGURES))
            yield b.filter(pa.array(held.value.score(x) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
