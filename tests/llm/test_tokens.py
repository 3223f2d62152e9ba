import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from regdelta.llm import bpe as B
from regdelta.llm import token_counts as T

TEXTS = [
    None,
    "",
    " ",
    "don't  stop\n\n now",
    "a<|endoftext|>b <|endoftext|><|endoftext|>",
    "<|endoftext|",
    "Ünï çødé 日本語 \U0001f600\U0001f468‍\U0001f469 \xa0x  y",
    "x\x1cy \x1cz\x00 5",
    "a" * 100_000,
    ("word 12 " * 12_000) + " " * 9_000 + "end",
    "\n" * 20_000 + "x" + " " * 50_000,
    "the the the",
    "the the the",
]
SCHEMA = "doc_id long, text string, token string, key string, n string"


def frame(spark):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (3, "other", "", "", ""), (3, TEXTS[3], "", "", ""), (None, "null id", None, None, None)], SCHEMA)


@pytest.mark.parametrize("heavy,sample", [(1 << 19, 1000), (3, 1000), (0, 1000)])
def test_counts_are_those_of_the_library(spark, heavy, sample):
    library = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
    docs = frame(spark)
    want = sorted(
        (str(r.doc_id), len((r.text or "").encode()), n, n > 1024)
        for r in docs.collect()
        for n in [len(library.encode(r.text or "", add_special_tokens=False))]
    )
    got = T.count_tokens(docs, heavy=heavy, sample_docs=sample).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        T.added_tokens(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(text):
    enc = B.encoding(public_tokenizers.path(B.RANKS))
    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc._encode_single_piece(m)]


def test_encoding_and_decoding(spark):
    docs = frame(spark)
    texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    want = sorted(
        (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        for i, t in texts
        for ids in [plain_ids(t)]
    )
    got = B.round_trip(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    kept = B.decode_ids(B.encode_texts(docs)).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in kept) == texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zé", "7", " ", "\n", "\xa0", "\x1c", "'s", "'", "!", " b", "   ", "日", "\t"]), max_size=60), st.integers(1, 9))
def test_pieces_cut_only_between_matches(parts, size):
    text = "".join(parts)
    pieces = list(B.safe_pieces(text, size))
    assert "".join(p for p, _ in pieces) == text
    assert [i for p, _ in pieces for i in plain_ids(p)] == plain_ids(text)


@pytest.mark.parametrize("text", ["x" + " " * 1_200_000 + "y", " " * 1_200_000, "ab" * 400_000, "1x " * 300_000])
def test_very_long_texts(text):
    enc = B.encoding(public_tokenizers.path(B.RANKS))
    ids = B.encode(enc, text)
    assert enc.decode_bytes(ids).decode() == text
    assert ids == plain_ids(text)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.count_tokens(empty).count() == 0 and B.round_trip(empty).count() == 0
