from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from evenhand.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "  ", " a", "a ", "a  b", "▁a", "a▁ b▁", "\n\n\tx", "<s> hi</s>", "日本 語", "\x00a", "é é ﬁ", "x" * 3000, "word " * 4000]


@pytest.fixture(scope="module")
def chunks():
    return pieces.ChunkTable("piece_bpe_32k.model", entries=50)


@pytest.mark.parametrize("text", ODD)
def test_equals_library(chunks, text):
    ids, decoded = chunks.both(text)
    expected = LIBRARY.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert decoded == LIBRARY.decode(expected)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ▁\n.é日́<>s/　"), max_size=40))
def test_equals_library_on_any_text(text):
    table = pieces.chunk_table("piece_bpe_32k.model")
    ids, decoded = table.both(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text)
    assert decoded == LIBRARY.decode(LIBRARY.encode(text))


def test_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, ids string, decoded string")
    got = pieces.digests(pieces.encode_decode(docs)).collect()

    def expected(key, text):
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        return key, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert pieces.encode_decode(docs.limit(0)).count() == 0
