from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenhand.llm import wavelet

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    "", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n \nb", "it's o'clock 'tis", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y ",
    "日本 語 é", "a  b", "a  b", "a\x1c b \x85c", "tab\t tab \tx", "x" * 3000, "word " * 4000, "1 23 456", "é ́x", "!!! ?",
]


@pytest.fixture(scope="module")
def table():
    return wavelet.WordTable("byte_bpe_50k.json", entries=60, together=3)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_words_equal_library(table, text):
    assert np.frombuffer(table.of([text])[0], "<u4").tolist() == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 's\n\t.1 é日́<|>\x1c"), max_size=30), min_size=1, max_size=4))
def test_words_equal_library_on_any_text(texts):
    got = wavelet.word_table("byte_bpe_50k.json").of(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9) | st.integers(0, 50_256), max_size=300), st.data())
def test_file_answers(ids, data):
    array = np.array(ids, np.int64)
    file = wavelet.WaveletFile(wavelet.build(array, pa.array([7]), np.array([len(ids)]), 3, 4))
    assert (file.part, file.shard, len(file), file.keys.to_pylist(), file.lengths.tolist()) == (3, 4, len(ids), [7], [len(ids)])
    assert file.ids().tolist() == ids
    low = data.draw(st.integers(0, len(ids)))
    high = data.draw(st.integers(low, len(ids)))
    for token in {*ids[:5], 11, 60_000}:
        places = [i for i in range(low, high) if ids[i] == token]
        assert file.count(token, low, high) == len(places)
        assert file.occurrences(token, low, high).tolist() == places
    if ids:
        places = data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=20))
        assert file.access(places).tolist() == [ids[i] for i in places]


def test_file_of_several_segments():
    ids = np.random.default_rng(1).zipf(1.3, 300_000) % 5_000
    file = wavelet.WaveletFile(wavelet.build(ids, pa.array(["a", None]), np.array([100_000, 200_000])))
    assert np.array_equal(file.ids(), ids)
    for token in (0, 1, 17, 4_999):
        assert np.array_equal(file.occurrences(token), np.flatnonzero(ids == token))
        assert file.count(token, 65_530, 131_080) == np.count_nonzero(ids[65_530:131_080] == token)
    places = np.array([0, 65_535, 65_536, 299_999])
    assert np.array_equal(file.access(places), ids[places])
    with pytest.raises(IndexError):
        file.access([300_000])
    with pytest.raises(ValueError):
        wavelet.WaveletFile(b"x" * 100)


ROWS = [(5, "b a. b"), (None, "null key"), (2, None), (3, ""), (9, "the end!"), (3, ""), (9, "the end!"), (9, "other"), (1, "long " * 500)]


def expected(rows):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library(text or ""), 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [1 << 22, 4])
def test_round_trip(spark, shard_tokens):
    rows = [r for r in ROWS if r[1] != "other"]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, part int").repartition(3)
    got = wavelet.round_trip(docs, shard_tokens=shard_tokens)
    found = sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert found == expected(rows)
    assert wavelet.round_trip(docs.limit(0)).count() == 0


def test_ties_keep_all_and_counts_and_occurrences(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    files = wavelet.write_files(docs, shard_tokens=30)
    read = wavelet.read_documents(files).orderBy("start").collect()
    assert [r["start"] for r in read] == np.cumsum([0, *[r["n_tokens"] for r in read]])[:-1].tolist()
    ids = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u4") for r in read}
    assert sorted((k is None, k or 0, tuple(library(t or "")) + (0,)) for k, t in ROWS) == sorted(
        (k is None, k or 0, tuple(x.tolist())) for (k, _), x in ids.items()
    )
    token = library("the")[0]
    counts = {r["token"]: r["n"] for r in wavelet.token_counts(files, [0, token, 49_999]).collect()}
    assert counts == {t: sum(int((x == t).sum()) for x in ids.values()) for t in (0, token, 49_999)}
    places = sorted(map(tuple, wavelet.occurrences(files, token).collect()))
    assert places == sorted((k, int(i)) for (k, _), x in ids.items() for i in np.flatnonzero(x == token))
