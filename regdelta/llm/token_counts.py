"""Token counts without token ids.

A byte-level BPE tokenizer first cuts a text into pre-tokens and merges inside each of
them alone, so a document has as many tokens as its pre-tokens have pieces. The texts are
turned into per-document pre-token frequencies, every distinct pre-token is given to the
library once, and the two are joined.

Pre-tokens that a sample of the corpus shows to be frequent travel to the tasks with
their counts (at most HEAVY of them); so no frequent word gathers its rows in one task.
All other pre-tokens are dealt by value: their distinct values are counted where they
arrive, sorted, and joined in place, in one shuffle. Which pre-tokens count as frequent has no
influence on the result.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, least_count, python_tasks, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Most pre-tokens that are sent to all tasks.
HEAVY = 1 << 19
#: About so many documents are read to find them.
SAMPLE_DOCS = 20_000
#: A document's own row, in place of a pre-token: no pre-token joins a control character with a digit.
DOCUMENT = regex.compile("\x00-?[0-9]+")


def added_tokens(path: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before pre-tokens are cut."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
        raise ValueError(f"{path}: pre-tokens are those of a plain byte-level tokenizer only")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
        raise ValueError(f"{path}: an added token takes its surroundings with it")
    return sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)


@lru_cache(maxsize=4)
def _cutter(path: str):
    specials = added_tokens(path)
    find = regex.compile(public_tokenizers.PATTERN).findall
    if not specials:
        return lambda text: (0, Counter(find(text)))
    special = regex.compile("|".join(map(regex.escape, specials)))

    def frequencies(text: str) -> tuple[int, Counter]:
        parts = special.split(text)
        got = Counter(find(parts[0]))
        for p in parts[1:]:
            got.update(find(p))
        return len(parts) - 1, got

    return frequencies


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_counter(path: str):
    @F.pandas_udf("int")
    def pieces(token: pd.Series) -> pd.Series:
        got = _library(path).encode_batch(token.tolist(), add_special_tokens=False)
        return pd.Series([len(e) for e in got], dtype="int32")

    return pieces


def heavy_pieces(docs: DataFrame, path: str, most: int, sample_docs: int) -> dict[str, int]:
    """Pieces of the pre-tokens that are in most documents of a sample; at most `most` of them."""
    spark = docs.sparkSession
    total = docs.count()
    if not total:
        return {}

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = _cutter(path)
        for b in batches:
            seen: Counter = Counter()
            for text in b.column("body").to_pylist():
                seen.update(frequencies(text or "")[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    sample = docs.sample(False, min(1.0, sample_docs / total), seed=7)
    counted = sample.mapInArrow(tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    counted = cut(counted, "heavy")
    least = least_count(counted, most)
    rows = counted.where(F.col("n") >= least).select("token", piece_counter(path)("token").alias("pieces")).toPandas()
    return dict(zip(rows["token"], rows["pieces"].tolist()))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    heavy: int = HEAVY,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    Texts are read whole; null counts as empty (no bytes, no tokens). A string of an
    added token inside a text is one token, as the library takes it. Rows that repeat
    id and text are counted together and come out as often as they went in; a repeated
    id with another text is a document of its own; null ids are kept. An empty input
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    python_tasks(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    known = spark.sparkContext.broadcast(heavy_pieces(rows, path, heavy, sample_docs))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies, pieces = _cutter(path), known.value
        for b in batches:
            ids, keys, tokens, ns, sizes = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                raw = (text or "").encode("utf-8")
                key = xxhash.xxh64_intdigest(raw) - (1 << 63)
                done, freq = frequencies(text or "")
                rare = []
                for token, n in freq.items():
                    p = pieces.get(token)
                    if p is None:
                        rare.append((token, n))
                    else:
                        done += n * p
                tokens.append(f"\x00{key}")
                ns.append(done)
                sizes.append(len(raw))
                for token, n in rare:
                    tokens.append(token)
                    ns.append(n)
                sizes.extend([-1] * len(rare))
                ids.extend([doc_id] * (len(rare) + 1))
                keys.extend([key] * (len(rare) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(tokens, pa.string()), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64())],
                ["doc_id", "key", "token", "n", "size"],
            )

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by pre-token: equal ones are neighbours and go to the library once."""
        library = _library(path)
        last, last_pieces = None, 0
        for b in batches:
            runs = pc.run_end_encode(b.column("token"))
            values = runs.values.to_pylist()
            own = [v for v in values if v[0] != "\x00" or not DOCUMENT.fullmatch(v)]
            if own and own[0] == last:
                got = [last_pieces, *(len(e) for e in library.encode_batch(own[1:], add_special_tokens=False))]
            else:
                got = [len(e) for e in library.encode_batch(own, add_special_tokens=False)]
            if own:
                last, last_pieces = own[-1], got[-1]
            each = iter(got)
            pieces = np.array([1 if v[0] == "\x00" and DOCUMENT.fullmatch(v) else next(each) for v in values], np.int64)
            ends = runs.run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
            repeat = np.diff(np.r_[0, ends])
            tokens = b.column("n").to_numpy() * np.repeat(pieces, repeat)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(tokens), b.column("size")], ["doc_id", "key", "tokens", "size"]
            )

    dealt = rows.mapInArrow(parts, "doc_id long, key long, token string, n long, size long")
    together = dealt.repartition("token").sortWithinPartitions("token")
    priced = together.mapInArrow(price, "doc_id long, key long, tokens long, size long")
    summed = priced.groupBy("doc_id", "key").agg(
        F.sum("tokens").alias("all_tokens"),
        F.max("size").alias("n_bytes"),
        F.count_if(F.col("size") >= 0).alias("copies"),
    )
    single = summed.withColumn("n_tokens", (F.col("all_tokens") / F.col("copies")).cast("long"))
    again = single.select("doc_id", "n_bytes", "n_tokens", F.explode(F.expr("sequence(1L, copies)")).alias("_i"))
    return again.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
