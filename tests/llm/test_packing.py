from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evenhand.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_words_equal_the_tokenizer():
    draw = random.Random(3)
    parts = [*"abXY's.!?01<|>_- \n\t", "'ll", "é", "É", "ß", "İ", "Σ", "日", "́", "²", "ª", "\xa0", "\x85", "🙂", "<|endoftext|>", "\x1c"]
    table = packing.WordIds("word_bpe_49k.json", entries=300)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    for at in range(0, len(texts), 60):
        some = texts[at : at + 60]
        for text, got in zip(some, table.of(some), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def optimum(pieces: list[int], capacity: int) -> int:
    """Least number of sequences by trying every placement."""
    best = len(pieces)

    def go(k: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if pieces[k] <= room:
                rest = list(rooms)
                rest[rest.index(room)] -= pieces[k]
                go(k + 1, tuple(rest))
        go(k + 1, (*rooms, capacity - pieces[k]))

    go(0, ())
    return best


def valid(patterns, pieces, capacity):
    used = Counter()
    for times, filling in patterns:
        assert sum(filling) <= capacity
        for p in filling:
            used[p] += times
    assert used == Counter(pieces)
    return sum(times for times, _ in patterns)


@pytest.mark.parametrize("seed", range(25))
def test_few_pieces_are_packed_optimally(seed):
    draw = random.Random(seed)
    pieces = sorted((draw.randint(1, 60) for _ in range(draw.randint(1, 9))), reverse=True)
    assert valid(packing.plan(Counter(pieces), 100), pieces, 100) == optimum(pieces, 100)


@pytest.mark.parametrize("seed", range(6))
def test_many_pieces_reach_the_bound(seed):
    draw = random.Random(seed)
    pieces = [min(1000, int(draw.expovariate(1 / 200)) + 1) for _ in range(5000)]
    assert valid(packing.plan(Counter(pieces), 1000), pieces, 1000) <= packing.lower_bound(Counter(pieces), 1000) + 1


def test_bounds_hold():
    draw = random.Random(1)
    for _ in range(60):
        pieces = sorted((draw.randint(1, 100) for _ in range(draw.randint(1, 7))), reverse=True)
        assert packing.lower_bound(Counter(pieces), 100) <= optimum(pieces, 100) <= len(packing.best_fit(pieces, 100))


def test_rows(spark):
    rows = [(1, "the cat " * 3000), (1, "same"), (1, "same"), (None, "x"), (2, None), (3, ""), (4, "a b c")]
    docs = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "doc_id long, text string, piece int, length int, offset int").repartition(3)
    got = packing.pack(docs).collect()
    expected = []
    for key, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            expected.append((key, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len({r["sequence_id"] for r in got}) == packing.lower_bound(Counter(r["length"] for r in got), 4096)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("long", [0, 40])
def test_very_many_tiny_pieces_fill_whole_sequences(long):
    draw = random.Random(long)
    pieces = [1] * 5000 + [draw.randint(1, 4096) for _ in range(long)]
    assert valid(packing.plan(Counter(pieces)), pieces, 4096) == packing.lower_bound(Counter(pieces), 4096)


def test_a_first_filling_is_complete_whatever_the_nodes():
    assert Counter(packing.best_filling(4000, {1: 3700, 300: 2}, [1, 300], nodes=1)) == {300: 2, 1: 3400}
    assert Counter(packing.best_filling(12, {2: 9, 5: 9, 8: 1}, [2, 5, 8])) == {8: 1, 2: 2}
    assert Counter(packing.best_filling(12, {5: 9, 7: 1, 8: 1}, [5, 7, 8])) == {7: 1, 5: 1}


def test_never_above_best_fit_decreasing():
    for seed in range(100):
        dice = random.Random(seed)
        top = dice.choice([40, 300, 4096])
        pieces = [min(top, int(dice.lognormvariate(dice.choice([2.0, 4.0, 6.0]), 1.2)) + 1) for _ in range(dice.choice([200, 700]))]
        counts = Counter(pieces)
        bins = packing.best_fit(pieces, top)
        kinds = packing.decreasing(counts, top)
        for patterns in (kinds, packing.plan(counts, top)):
            held = Counter()
            for times, filling in patterns:
                assert times > 0 and sum(filling) <= top
                for k in filling:
                    held[k] += times
            assert held == counts
        assert sum(t for t, _ in kinds) == len(bins)
        assert sum(t for t, _ in packing.plan(counts, top)) <= len(bins)
