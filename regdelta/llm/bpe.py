"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import python_tasks, table, tidy

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters from which a text is split, and least characters of a split.
LONG = 1 << 16
#: White space of the Unicode standard; longer runs of it exceed the library's matching stack.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = regex.compile(BLANK + r"{4096,}")
#: Places that end a match of the pattern whatever follows: a letter or digit before a
#: blank or before the other of the two, and the last blank of a run that goes on to a word.
BOUNDARY = regex.compile(rf"(?<=[\p{{L}}\p{{N}}])(?={BLANK})|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})|(?<={BLANK})(?={BLANK}[\p{{L}}\p{{N}}])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG) -> Iterator[tuple[str, bool]]:
    """Cuts a text where the pattern cannot match across; (piece, whether it is one match, a run of blanks)."""
    at = 0
    for run in [*LONG_RUN.finditer(text), None]:
        start, end = run.span() if run else (len(text), len(text))
        while start - at > size:
            cut = BOUNDARY.search(text, at + size, start)
            if not cut:
                break
            yield text[at : cut.start()], False
            at = cut.start()
        if start > at:
            yield text[at:start], False
        if run:
            at = end if end == len(text) else end - 1
            yield text[start:at], True


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids that the library gives for the whole text."""
    if len(text) < 4096:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, blank in safe_pieces(text):
        ids += enc._encode_single_piece(piece) if blank else enc.encode_ordinary(piece)
    return ids


def encode_texts(docs: DataFrame, rank_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in one binary value.

    Whole texts, whatever their length; null counts as empty and gives no ids. Repeated
    rows and null ids are encoded like any other row; an empty input gives an empty
    result; other columns are not read. A task holds one batch of texts, no more.
    """
    path = rank_path or public_tokenizers.path(RANKS)
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            counts, ids = [], []
            for text in b.column("body").to_pylist():
                got = np.array(encode(enc, text or ""), "<u4")
                counts.append(len(got))
                ids.append(got.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, rank_path: str | None = None) -> DataFrame:
    """Adds `decoded`, the raw bytes of the ids: a piece of a character stays as it is. Null ids give no bytes."""
    path = rank_path or public_tokenizers.path(RANKS)
    python_tasks(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "decoded"])

    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    kept = encoded.select(*[f.name for f in fields])
    return kept.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded binary")


def round_trip(docs: DataFrame, rank_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to."""
    both = decode_ids(encode_texts(docs, rank_path), rank_path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
