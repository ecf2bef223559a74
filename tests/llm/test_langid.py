from __future__ import annotations

import zlib

import numpy as np
import pytest

from evenhand.llm import langid

VOCABULARY = "piece_bpe_32k.model"


def all_segmentations(lattice, word, probability):
    """The sum over every way to cut the marked word into pieces, one by one."""
    pieces = {}
    marked = langid.MARK + word

    def piece_of(part):
        state = 0
        for c in part:
            state = lattice.nodes.get((state, lattice.code.get(c, 0)), -1)
            if state < 0:
                return None
        return lattice.piece_at[state] if lattice.piece_at[state] >= 0 else None

    for a in range(len(marked)):
        for b in range(a + 1, min(len(marked), a + lattice.longest) + 1):
            p = piece_of(marked[a:b])
            if p is None and b == a + 1:
                p = lattice.unknown
            if p is not None:
                pieces.setdefault(a, []).append((b, p))

    def go(at):
        if at == len(marked):
            return np.ones(probability.shape[1])
        return sum((probability[p] * go(b) for b, p in pieces.get(at, [])), np.zeros(probability.shape[1]))

    return np.log(go(0))


@pytest.fixture(scope="module")
def lattice():
    return langid.lattice(VOCABULARY)


@pytest.mark.parametrize("word", ["a", "the", "straße", "niño", "хлеб", "日本", "qxzzq", "ᚠx"])
def test_forward_sums_all_segmentations(lattice, word):
    p = np.random.default_rng(1).random((lattice.size, 3)) + 0.01
    p /= p.sum(axis=0)
    got = lattice.log_likelihood([word, "pad" + word], p)[0]
    assert np.allclose(got, all_segmentations(lattice, word, p))


def test_long_words_agree_with_the_array_form(lattice):
    p = np.random.default_rng(2).random((lattice.size, 2)) + 0.01
    p /= p.sum(axis=0)
    word = "donaudampfschifffahrt" * 3
    long = lattice.long_word(langid.MARK + word, lattice.scaled(p)) - (len(word) + 1) * np.log(langid.SCALE)
    assert np.allclose(long, lattice.log_likelihood([word[:63]], p)[0] if len(word) == 63 else long)
    assert np.isfinite(lattice.log_likelihood(["ab" * 2000], p)).all()


def test_expected_uses_sum_to_the_words_letters(lattice):
    p = np.full((lattice.size, 1), 1 / lattice.size)
    words, n = ["haus", "maus", "日本"], np.array([2.0, 1.0, 3.0])
    uses = lattice.expected(words, n, np.zeros(3, np.int64), p)
    letters = (uses[:, 0] * lattice.lengths).sum()
    assert np.isclose(letters, sum(k * (len(w) + 1) for w, k in zip(words, n, strict=True)))


def log_sum(lattice, word, p):
    """Forward sums of one language in logarithms, one piece after the other."""
    codes = [lattice.code.get(c, 0) for c in langid.MARK + word]
    sums = [0.0] + [-np.inf] * len(codes)
    for a in range(len(codes)):
        if not lattice.covered[codes[a]]:
            sums[a + 1] = np.logaddexp(sums[a + 1], sums[a] + np.log(p[lattice.unknown]))
        state = 0
        for b in range(a, len(codes)):
            state = lattice.nodes.get((state, codes[b]), -1)
            if state < 0:
                break
            if lattice.piece_at[state] >= 0:
                sums[b + 1] = np.logaddexp(sums[b + 1], sums[a] + np.log(p[lattice.piece_at[state]]))
    return sums[-1]


@pytest.mark.parametrize("length", [40, 48, 60, 63])
def test_rare_letters_of_a_large_corpus_do_not_underflow(lattice, length):
    rare, n = 1.1e-12, 1e9
    p = np.full((lattice.size, 2), rare)
    p[1] = 1 - rare * (lattice.size - 1)
    p[:, 1] = 1 / lattice.size
    word = "ᚠ" * (length - 5) + "qжxहz"
    got = lattice.log_likelihood([word, "the"], p)
    assert np.allclose(got[0], [log_sum(lattice, word, p[:, k]) for k in (0, 1)])
    assert np.allclose(got[1], [log_sum(lattice, "the", p[:, k]) for k in (0, 1)])
    uses = lattice.expected([word, "the", word], np.array([1.0, n, 2.0]), np.array([0, 0, 1]), p)
    assert np.isfinite(uses).all()
    assert np.isclose(uses[lattice.unknown, 0], length - 5)
    assert np.isclose((uses[:, 1] * lattice.lengths).sum(), 2 * (length + 1))
    assert np.isclose((uses[:, 0] * lattice.lengths).sum(), n * 4 + length + 1)


def held(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


def test_rows(spark):
    samples = {"de": "der hund und die katze schlafen nicht", "en": "the dog and the cat are not asleep"}
    rows = [(k, samples[x], x) for k, x in enumerate(["de", "en"] * 20)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 ²³ !?", "en"), (103, "the dog", None), (None, "und die katze", None), (0, samples["de"], "de")]
    docs = spark.createDataFrame([(*r, "z") for r in rows + odd], "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by_key = {r["doc_id"]: r for r in got}
    for key, _, lang in rows:
        assert by_key[key]["lang_pred"] == lang and by_key[key]["held_out"] == held(key) and 0.5 < by_key[key]["score"] <= 1
    assert [by_key[k]["lang_pred"] for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert by_key[100]["score"] == 0
    kept = langid.known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    assert {r["score"] for r in kept.collect()} == {"z"}
    assert langid.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(0, 0).cast("string")).where("lang is null")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
