"""Language identification by interpolated Kneser-Ney character models.

Counting: every learned text becomes a sequence of lower-case letters, runs of anything
else being one blank, and Spark counts its character four-grams by language, over all
learned texts. Shorter orders get continuation counts, as Kneser and Ney have it: in how
many different left contexts a gram was seen.

The model: for each order one sorted array of 64-bit gram hashes, common to all languages, with the
interpolated log probability in each language beside it; and one of context hashes
with back-off weights. It is broadcast while no order has more than MAX_GRAMS rows, nor its
arrays more than CELLS * MAX_GRAMS cells. A larger model stays in Spark as tables by gram, and
only the probabilities of the most frequent four-grams, within the same cells, are broadcast;
four-grams of a text that are not among them are joined to the tables. Both ways give the same model.

Scoring: binary search of a text's four-grams, sums by text, and the language of the
lowest cross-entropy a symbol. A text whose cross-entropy is above what nearly all
calibration texts of that language have is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, fold, hash_edge, least_count, python_tasks, table

ORDER = 4
#: Most (language, gram) rows of one order in a model that is broadcast whole.
MAX_GRAMS = 1 << 20
#: Arrays that are broadcast have a cell for each gram and language: most cells are so many times MAX_GRAMS, however many the languages.
CELLS = 4
#: Symbols that are worked on at once.
SYMBOLS = 1 << 20
#: About so many texts calibrate the scores and the rejection; they are not counted.
CALIBRATION_TEXTS = 4_000
#: Share of a language's calibration texts that its rejection threshold accepts.
ACCEPTED = 0.995
BLANK, START = 32, 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to the symbol it counts as: a lower-case letter, or the blank."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One sequence for all texts and where each starts; three start marks open a text, a blank ends it if it has letters."""
    mark = chr(START) * (ORDER - 1)
    joined = "".join(f"{mark}{t} " for t in texts)
    s = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.r_[0, np.cumsum([len(t) + ORDER for t in texts])[:-1]].astype(np.int64) if texts else np.array([], np.int64)
    for k in range(ORDER - 1):
        s[starts + k] = START
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != BLANK) | ((s[:-1] != BLANK) & (s[:-1] != START))
    # a leading blank goes; START survives
    at = np.cumsum(keep) - 1
    return s[keep], at[starts]


def hashes(s: np.ndarray, order: int) -> np.ndarray:
    """Hash of the gram of that order that ends at each position from order - 1 on."""
    c = s.astype(np.uint64)
    h = c[: len(c) - order + 1].copy()
    for k in range(1, order):
        h = h * FACTOR + c[k : len(c) - order + 1 + k]
    return h


def gram_hashes(grams: pd.Series, order: int) -> np.ndarray:
    s = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, order).astype(np.uint64)
    h = s[:, 0].copy()
    for k in range(1, order):
        h = h * FACTOR + s[:, k]
    return h


def portions(texts: list[str], size: int = SYMBOLS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of together about `size` characters, at least one text each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if texts:
        yield start, len(texts)


class _Tally:
    """Counts of (language, four-gram), merged by their hash."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, texts: list[str], langs: list[str]) -> None:
        s, starts = symbols(texts)
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        code = np.repeat(codes, np.diff(np.r_[starts, len(s)]))
        for a in range(0, len(s), SYMBOLS):
            part = s[a : a + SYMBOLS + ORDER - 1]
            if len(part) < ORDER:
                continue
            end = np.flatnonzero(part[ORDER - 1 :] != START)
            c = code[a : a + len(part)][ORDER - 1 :][end]
            h = hashes(part, ORDER)[end] + c.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            keys, first, n = np.unique(h, return_index=True, return_counts=True)
            at = end[first]
            self.parts.append((keys, n, c[first], np.stack([part[at + k] for k in range(ORDER)], 1)))
            self.held += len(keys)
            if self.held > 1 << 21:
                self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        keys, n, c, g = (np.concatenate(x) for x in zip(*self.parts))
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        self.parts = [(keys, np.bincount(back, n).astype(np.int64), c[first], g[first])]
        self.held = len(keys)

    def rows(self) -> pa.RecordBatch:
        self.merge()
        names = list(self.langs)
        _, n, c, g = self.parts[0] if self.parts else (None, np.array([], np.int64), np.array([], np.int64), np.zeros((0, ORDER), np.uint32))
        text = g.astype("<u4").tobytes().decode("utf-32-le")
        grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in c], pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for b in batches:
        texts, langs = b.column("body").to_pylist(), b.column("lang").to_pylist()
        for i, j in portions(texts):
            tally.add(texts[i:j], langs[i:j])
        if tally.held > 1 << 20:
            tally.merge()
            if tally.held > 1 << 20:
                yield tally.rows()
    yield tally.rows()


class Models:
    """Models of all languages; probabilities are natural logarithms."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.keys: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.ctx: dict[int, np.ndarray] = {}
        self.gamma: dict[int, np.ndarray] = {}
        self.floor = np.zeros(len(langs))
        self.sharpness = 20.0
        self.threshold = np.full(len(langs), np.inf)
        #: The whole model in Spark, where the arrays hold the most frequent four-grams alone; tasks do not get it.
        self.tables: Tables | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def log_prob(self, windows: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """windows: grams as rows of symbols, all of one order; a row of log probabilities each."""
        order = windows.shape[1]
        if order == 0:
            return np.tile(self.floor, (len(windows), 1))
        if h is None:
            h = windows[:, 0].astype(np.uint64)
            for k in range(1, order):
                h = h * FACTOR + windows[:, k].astype(np.uint64)
        at, hit = self._find(self.keys[order], h)
        out = self.logp[order][at] if len(self.keys[order]) else np.zeros((len(h), len(self.langs)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            below = self.log_prob(windows[miss, 1:])
            if order > 1:
                below = below + self.back_off(windows[miss, :-1])
            out[miss] = below
        return out

    def back_off(self, contexts: np.ndarray) -> np.ndarray:
        order = contexts.shape[1]
        h = contexts[:, 0].astype(np.uint64)
        for k in range(1, order):
            h = h * FACTOR + contexts[:, k].astype(np.uint64)
        at, hit = self._find(self.ctx[order], h)
        out = np.zeros((len(h), len(self.langs)), np.float32)
        if len(self.ctx[order]):
            out[hit] = self.gamma[order][at[hit]]
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol of each text in each language, and the number of symbols."""
        total, size = self.sums(texts)
        return -total / np.maximum(size, 1)[:, None], size

    def sums(self, texts: list[str], missed: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and the number of symbols.

        missed: takes (text, four-gram as symbols) of those that the arrays lack; they are left out of the sums then.
        """
        s, starts = symbols(texts)
        total = np.zeros((len(texts), len(self.langs)))
        size = np.diff(np.r_[starts, len(s)]) - (ORDER - 1)
        doc = np.repeat(np.arange(len(texts)), size + ORDER - 1)
        step = max(ORDER, SYMBOLS // 4 // max(1, len(self.langs) // 8))
        for a in range(0, len(s) - ORDER + 1, step):
            part = s[a : a + step + ORDER - 1]
            end = np.flatnonzero(part[ORDER - 1 :] != START)
            if not len(end):
                continue
            h = hashes(part, ORDER)[end]
            at, hit = self._find(self.keys[ORDER], h)
            got = self.logp[ORDER][at] if len(self.keys[ORDER]) else np.zeros((len(h), len(self.langs)), np.float32)
            owner = doc[a : a + len(part)][ORDER - 1 :][end]
            miss = np.flatnonzero(~hit)
            if len(miss):
                windows = np.stack([part[end[miss] + k] for k in range(ORDER)], 1)
                if missed is None:
                    got[miss] = self.log_prob(windows, h[miss])
                else:
                    got[miss] = 0
                    missed.append((owner[miss], windows))
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            total[owner[cuts]] += np.add.reduceat(got, cuts, axis=0, dtype=np.float64)
        return total, size

    def confidence(self, entropy: np.ndarray) -> np.ndarray:
        d = entropy - entropy.min(axis=1, keepdims=True)
        return 1.0 / np.exp(-self.sharpness * d).sum(axis=1)


class Tables:
    """The whole model by gram: logp[k] (gram, p) and gamma[k] (ctx, g), arrays of natural logarithms in the order of the languages."""

    def __init__(self, floor: list[float]):
        self.floor = floor
        self.logp: dict[int, DataFrame] = {}
        self.gamma: dict[int, DataFrame] = {}

    def log_prob(self, grams: DataFrame) -> DataFrame:
        """(gram, p) of four-grams, none of them twice."""
        out, p = grams.select("gram"), F.array(*map(F.lit, self.floor))
        for k in range(1, ORDER + 1):
            own = F.substring("gram", ORDER - k + 1, k)
            if k > 1:
                ctx = F.substring("gram", ORDER - k + 1, k - 1)
                table = self.gamma[k - 1].withColumnsRenamed({"ctx": "_c", "g": f"_g{k}"})
                out = out.join(table, ctx == F.col("_c"), "left").drop("_c")
                p = F.when(F.col(f"_g{k}").isNull(), p).otherwise(F.zip_with(p, f"_g{k}", lambda a, b: a + b))
            table = self.logp[k].withColumnsRenamed({"gram": "_s", "p": f"_p{k}"})
            out = out.join(table, own == F.col("_s"), "left").drop("_s")
            p = F.coalesce(f"_p{k}", p)
        return out.select("gram", p.alias("p"))


def _discounts(grams: DataFrame, langs: list[str]) -> np.ndarray:
    once = {r["lang"]: r for r in grams.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
    discount = np.array([0.5 if not once[x]["n1"] else once[x]["n1"] / (once[x]["n1"] + 2 * once[x]["n2"]) for x in langs])
    return np.clip(discount, 0.1, 0.9)


def _tables(orders: dict[int, DataFrame], langs: list[str], size: int) -> Tables:
    tables = None
    for k in range(1, ORDER + 1):
        discount = _discounts(orders[k], langs)
        by_lang = F.create_map(*[F.lit(v) for x, d in zip(langs, discount.tolist()) for v in (x, d)])

        def wide(value, other: float):
            return F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, value)), F.lit(other)) for x in langs])

        grams = orders[k].withColumn("ctx", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        totals = grams.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        left = F.greatest(by_lang[F.col("lang")] * F.col("kinds") / F.col("total"), F.lit(1e-12))
        gamma = cut(totals.groupBy("ctx").agg(wide(left, 1.0).alias("g")), "gamma")
        alpha = (F.col("n") - by_lang[F.col("lang")]) / F.col("total")
        mass = grams.join(totals, ["lang", "ctx"]).groupBy("gram", "ctx").agg(wide(alpha, 0.0).alias("mass"))
        if k == 1:
            rest = [g / size for g in gamma.first()["g"]]
            tables = Tables(np.log(rest).tolist())
            p = F.zip_with("mass", F.array(*map(F.lit, rest)), lambda a, b: F.log(a + b))
        else:
            # the end and the beginning of a gram that was seen were seen as well
            below = tables.logp[k - 1].select(F.col("gram").alias("_s"), F.col("p").alias("below"))
            mass = mass.join(gamma, "ctx").join(below, F.substring("gram", 2, k - 1) == F.col("_s"))
            p = F.zip_with("mass", F.zip_with("g", "below", lambda g, b: g * F.exp(b)), lambda a, b: F.log(a + b))
            tables.gamma[k - 1] = gamma.select("ctx", F.transform("g", lambda x: F.log(x)).alias("g"))
        tables.logp[k] = cut(mass.select("gram", p.alias("p")), "model")
    return tables


def train(learned: DataFrame) -> Models | None:
    """Models from (lang, body) rows, none of them null; None without a single gram."""
    counts = learned.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    orders = {ORDER: cut(counts, "grams")}
    for k in range(ORDER - 1, 0, -1):
        longer = orders[k + 1].select("lang", F.substring("gram", 2, k).alias("gram"))
        orders[k] = cut(longer.groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams")
    langs = sorted(r["lang"] for r in orders[1].select("lang").distinct().collect())
    if not langs:
        return None
    models = Models(langs)
    code = {x: i for i, x in enumerate(langs)}
    size = orders[1].select("gram").distinct().count() + 1
    models.floor = np.full(len(langs), -np.log(size))
    grams, wide = zip(*[orders[k].agg(F.count("*"), F.countDistinct("gram")).first() for k in orders])
    if max(grams) > MAX_GRAMS or max(wide) * len(langs) > CELLS * MAX_GRAMS:
        models.tables = _tables(orders, langs, size)
        counted = cut(orders[ORDER].groupBy("gram").agg(F.sum("n").alias("n")), "grams")
        frequent = counted.where(F.col("n") >= least_count(counted, CELLS * MAX_GRAMS // len(langs))).select("gram")
        held = models.tables.logp[ORDER].join(frequent, "gram", "left_semi")
        rows = held.select("gram", *[F.col("p")[i].cast("float").alias(f"p{i}") for i in range(len(langs))]).toPandas()
        h = gram_hashes(rows["gram"], ORDER) if len(rows) else np.array([], np.uint64)
        order = np.argsort(h)
        models.keys[ORDER] = h[order]
        models.logp[ORDER] = rows.drop(columns="gram").to_numpy(np.float32)[order]
        return models
    for k in range(1, ORDER + 1):
        grams = orders[k]
        discount = _discounts(grams, langs)
        ctx = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        totals = grams.groupBy("lang", ctx.alias("ctx")).agg(F.sum("n").alias("total"))
        rows = grams.withColumn("ctx", ctx).join(totals, ["lang", "ctx"]).select("lang", "gram", "n", "total").toPandas()
        lang = rows["lang"].map(code).to_numpy(np.int64)
        alpha = (rows["n"].to_numpy(float) - discount[lang]) / rows["total"].to_numpy(float)
        h = gram_hashes(rows["gram"], k) if len(rows) else np.array([], np.uint64)
        keys, first, where = np.unique(h, return_index=True, return_inverse=True)
        symbols_of = np.frombuffer("".join(rows["gram"].to_numpy()[first]).encode("utf-32-le"), "<u4").reshape(-1, k)
        mass = np.zeros((len(keys), len(langs)))
        mass[where, lang] = alpha
        if k > 1:
            ch = gram_hashes(rows["gram"].str[:-1], k - 1)
            ctx_keys, ctx_at = np.unique(ch, return_inverse=True)
            spent = np.zeros((len(ctx_keys), len(langs)))
            np.add.at(spent, (ctx_at, lang), alpha)
            models.ctx[k - 1] = ctx_keys
            models.gamma[k - 1] = np.log(np.clip(1.0 - spent, 1e-12, 1.0)).astype(np.float32)
            below = np.exp(models.log_prob(symbols_of[:, 1:]) + models.back_off(symbols_of[:, :-1]))
        else:
            spent = np.zeros(len(langs))
            np.add.at(spent, lang, alpha)
            left = np.clip(1.0 - spent, 1e-12, 1.0)
            below = left / size
            models.floor = np.log(left / size)
        models.keys[k] = keys
        models.logp[k] = np.log(mass + below).astype(np.float32)
    return models


def _joined_entropies(models: Models, texts: DataFrame, kept: str) -> DataFrame:
    """(kept, e, size): the cross-entropies of (kept, body) rows by a model whose tables are in Spark.

    Texts are known by a 128-bit hash. Sums over the frequent four-grams are made where the text is; others go by gram
    to the tables, once for each text and gram, and their sums return to the text.
    """
    held = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            own = [t or "" for t in b.column("body").to_pylist()]
            for i, j in portions(own):
                missed: list[tuple[np.ndarray, np.ndarray]] = []
                total, size = m.sums(own[i:j], missed)
                rare: list[list[dict]] = [[] for _ in range(j - i)]
                if missed:
                    owner, grams = (np.concatenate(x) for x in zip(*missed))
                    rows, n = np.unique(np.column_stack([owner.astype(np.uint32), grams]), axis=0, return_counts=True)
                    text = rows[:, 1:].astype("<u4").tobytes().decode("utf-32-le")
                    for at, (doc, times) in enumerate(zip(rows[:, 0].tolist(), n.tolist())):
                        rare[doc].append({"gram": text[ORDER * at : ORDER * (at + 1)], "n": times})
                keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in own[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(kept).slice(i, j - i),
                        pa.array(keys, pa.binary()),
                        pa.array(total.tolist(), pa.list_(pa.float64())),
                        pa.array(size, pa.int64()),
                        pa.array(rare, pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())]))),
                    ],
                    [kept, "key", "known", "size", "rare"],
                )

    found = cut(texts.select(kept, "body").mapInArrow(run, f"{kept} {texts.schema[kept].dataType.simpleString()}, key binary, known array<double>, size long, rare array<struct<gram:string,n:long>>"), "entropy")
    rare = found.select("key", F.inline("rare")).groupBy("key", "gram").agg(F.max("n").alias("n"))
    priced = rare.join(models.tables.log_prob(rare.select("gram").distinct()), "gram")
    langs = range(len(models.langs))
    sums = priced.groupBy("key").agg(F.array(*[F.sum(F.col("n") * F.col("p")[i]) for i in langs]).alias("more"))
    total = F.when(F.col("more").isNull(), F.col("known")).otherwise(F.zip_with("known", "more", lambda a, b: a + b))
    entropy = F.transform(total, lambda x: -x / F.greatest("size", F.lit(1)))
    return found.drop("rare").join(sums, "key", "left").select(kept, entropy.alias("e"), "size")


def calibrate(models: Models, texts: DataFrame) -> None:
    """Sets how sharply differences of cross-entropy become confidence, and each language's rejection threshold."""
    held = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("body").to_pylist()
            for i, j in portions(own):
                entropy, size = held.value.cross_entropy(own[i:j])
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(i, j - i), pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(size)], ["lang", "e", "size"])

    judged = _joined_entropies(models, texts, "lang") if models.tables else texts.mapInArrow(run, "lang string, e array<double>, size long")
    rows = judged.where("size > 1").toPandas()
    code = {x: i for i, x in enumerate(models.langs)}
    rows = rows[rows["lang"].isin(code.keys())]
    if len(rows) < 30:
        return
    e, lang = np.stack(rows["e"].to_numpy()), rows["lang"].map(code).to_numpy(np.int64)
    d = e - e.min(axis=1, keepdims=True)
    best = None
    for sharpness in np.geomspace(0.5, 200, 40):
        p = np.exp(-sharpness * d)
        likely = np.log(np.maximum(p[np.arange(len(p)), lang] / p.sum(axis=1), 1e-9)).mean()
        if best is None or likely > best[0]:
            best = (likely, sharpness)
    models.sharpness = float(best[1])
    for i in range(len(models.langs)):
        own = e[(lang == i) & (e.argmin(axis=1) == i), i]
        if len(own) >= 20:
            models.threshold[i] = float(np.quantile(own, ACCEPTED)) + 0.05


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy: one row per input row.

    Learns from rows whose fold (crc32 of the id as text, modulo 4) is not 2 and whose
    text and language are not null; rows with a null id are judged, not learned, and not
    held out. A text that is null or without a letter is `und`, with score 0 and no
    cross-entropy; so is every text if there is nothing to learn. rejected: the text
    is unlike the calibration texts of its nearest language; lang_pred names that language
    still. Equal cross-entropies go to the first language by name. Texts are read whole;
    repeated rows are judged alike; an empty input gives an empty result. Other columns
    are not read.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang"))
    part = fold(F.col("doc_id"), 64)
    labelled = rows.where("body is not null and lang is not null and doc_id is not null").where(part % 4 != 2).select("doc_id", "lang", "body", part.alias("part"))
    # about CALIBRATION_TEXTS texts of fold 3 calibrate, all others are counted
    apart = F.col("part") == 3
    drawn = apart & (F.xxhash64("doc_id") <= F.lit(hash_edge(labelled.where(apart).count(), CALIBRATION_TEXTS)))
    models = train(labelled.where(~drawn).select("lang", "body"))
    if models:
        # an id counts once, however many rows repeat it
        calibrate(models, labelled.where(drawn).groupBy("doc_id").agg(F.min(F.struct("lang", "body")).alias("r")).select("r.*"))
    held = spark.sparkContext.broadcast(models)
    joined = bool(models and models.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = [""] * b.num_rows if joined else [t or "" for t in b.column("body").to_pylist()]
            for i, j in portions(texts):
                n = j - i
                lang, score, far, best = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool), np.full(n, np.nan)
                if m:
                    if joined:
                        entropy, size = np.array(b.column("e").slice(i, n).to_pylist()), b.column("size").slice(i, n).to_numpy()
                    else:
                        entropy, size = m.cross_entropy(texts[i:j])
                    known = size > 0
                    pick = entropy.argmin(axis=1)
                    lang[known] = np.array(m.langs, object)[pick[known]]
                    score = np.where(known, m.confidence(entropy), 0.0)
                    best = np.where(known, entropy[np.arange(n), pick], np.nan)
                    far = known & (best > m.threshold[pick])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, n), pa.array(lang, pa.string()), pa.array(score), pa.array(far), pa.array(best, from_pandas=True)],
                    ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"],
                )

    source = _joined_entropies(models, rows, "doc_id") if joined else rows.select("doc_id", "body")
    out = source.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
