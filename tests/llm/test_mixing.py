from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from evenhand.llm import mixing


def words(seed=1, n=400):
    draw = np.random.default_rng(seed)
    parts = ["ka", "lo", "mi", "é", "ß", "to", "x"]
    return Counter("".join(draw.choice(parts, draw.integers(1, 5))).encode() for _ in range(n))


def fitted(found):
    raw = sorted(mixing.pieces(w)[0] for w in found)
    n = np.array([found[r[:-1]] for r in raw], float)
    tables = [np.zeros((2, s)) for s in mixing.SLOTS]
    mixing.context_counts(raw, n, tables)
    mixer = mixing.Mixer()
    mixing.train(raw, n, tables, {}, mixer)
    return raw, n, tables, mixer


def test_probabilities_of_all_continuations_sum_to_one():
    raw, n, tables, mixer = fitted(words())
    # all words of one byte and the mark alone: their paths' first decisions partition the space
    every = sorted(bytes([b]) + bytes([c]) for b in range(256) for c in range(256))
    keep = mixing.score(every, np.zeros(len(every)), tables, {}, mixer)
    assert np.isclose((10**keep).sum(), 1, atol=1e-6)


def test_decisions_are_counted():
    raw, n, *_ = fitted(words())
    walk = mixing.Walk(raw, n)
    for byte, bit, active, starts, bits in walk.levels():
        n0, n1 = mixing._decisions(walk, {}, byte, bit, active, starts, bits) if len(active) else ((), ())
        found = {}
        for w, c in zip(raw, n, strict=True):
            if len(w) > byte:
                b = "".join(f"{x:08b}" for x in w)
                pair = found.setdefault(b[: 8 * byte + bit], [0, 0])
                pair[int(b[8 * byte + bit])] += c
        assert sorted(map(list, zip(n0, n1, strict=True))) == sorted(found.values())


def test_words_shared_by_ranges_count_alike():
    raw, n, tables, mixer = fitted(words())
    whole = mixing.score(raw, n, tables, {}, mixer)
    cuts = [0, 40, 41, 150, len(raw)]
    sums = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        for key, (x, y) in mixing.paths(raw[a:b], n[a:b]).items():
            old = sums.get(key, (0, 0))
            sums[key] = (old[0] + x, old[1] + y)
    parts = [mixing.score(raw[a:b], n[a:b], tables, sums, mixer) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert np.allclose(np.concatenate(parts), whole)


def test_learning_helps():
    raw, n, tables, mixer = fitted(words(1, 3000))
    other = words(2, 3000)
    new = sorted(mixing.pieces(w)[0] for w in set(other) | {r[:-1] for r in raw})
    known = dict(zip(raw, n, strict=True))
    counts = np.array([known.get(w, 0.0) for w in new])
    weight = np.array([other[w[:-1]] for w in new], float)
    learned = (mixing.score(new, counts, tables, {}, mixer) * weight).sum()
    fresh = (mixing.score(new, counts, tables, {}, mixing.Mixer()) * weight).sum()
    assert learned > fresh


def test_rows(spark):
    draw = np.random.default_rng(4)
    vocabulary = [w.decode() for w in words(3, 200)]
    rows = [(k, " ".join(draw.choice(vocabulary, 30))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\x0b \t"), (103, "ABC ÀÉ " * 50), (104, "q" * 300), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    got = mixing.scored(docs, range_words=60, frequent=20).collect()
    held = lambda key: zlib.crc32(("null" if key is None else str(key)).encode()) % 7 == 2
    tokens = [mixing.tokens(t or "") for _, t in rows]
    counts = Counter(w for (key, _), found in zip(rows, tokens, strict=True) if not held(key) for w in found)
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for (key, _), found in zip(rows, tokens, strict=True):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in found)
        expected.append((key, held(key), len(found), sum(counts[w] > 0 for w in found), total, round(base, 6)))
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=str) == sorted(expected, key=str)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    # equal texts have equal scores, however words are dealt out
    again = {r["doc_id"]: r["score"] for r in mixing.scored(docs, range_words=60, frequent=500).collect()}
    assert all(np.isclose(again[r["doc_id"]], r["score"]) for r in got)
    assert mixing.scored(docs.limit(0)).count() == 0


def test_tokens_follow_the_rule():
    assert mixing.tokens("A\tbÉ\x0b\x1cX\x85y ") == [b"a", "bÉ".encode(), "\x1cx\x85y".encode(), mixing.END]
    assert mixing.pieces(("é" * 40).encode()) == [("é" * 32).encode() + mixing.PIECE_MARK, ("é" * 8).encode() + mixing.WORD_MARK]


def texts(seed, n=60, size=40):
    """Texts of a chain of words: every word is mostly followed by one of two others."""
    draw = np.random.default_rng(seed)
    names = [w.decode() for w in words(5, 120)]
    after = np.random.default_rng(9).integers(0, len(names), (len(names), 2))
    out = []
    for _ in range(n):
        at, found = draw.integers(len(names)), []
        for _ in range(size):
            found.append(names[at])
            at = after[at, draw.integers(2)] if draw.random() < 0.8 else draw.integers(len(names))
        out.append(" ".join(found))
    return out


def test_the_word_before_is_a_context(spark):
    draw = np.random.default_rng(6)
    held = [k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 7 == 2]
    in_order = texts(2, 20)
    mixed = [" ".join(draw.permutation(t.split())) for t in in_order]
    rows = list(enumerate(texts(1, 300))) + list(zip(held, in_order + mixed, strict=False))
    got = {r["doc_id"]: r for r in mixing.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for a, b in zip(held[:20], held[20:40], strict=True):
        assert got[a]["held_out"] and np.isclose(got[a]["base_score"], got[b]["base_score"]) and got[a]["n_known"] == got[b]["n_known"]
    before, after = (sum(got[k]["score"] for k in part) for part in (held[:20], held[20:40]))
    assert before > after + 50  # the same words, in the order of the other texts
    assert before > sum(got[k]["base_score"] for k in held[:20])  # and better than words by themselves


def test_scores_by_brute_force(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts(3, 70, 15))] + [(900, None), (901, "never seen"), (902, "never seen"), (None, "x"), (7, "again and again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = []
    monkeypatch.setattr(mixing, "trust", lambda counts, f=mixing.trust: learned.append((counts, f(counts))) or learned[-1][1])
    # many chunks, parts of words and parts of pairs, few words known to every worker
    for name, n in (("TOKENS", 100), ("PAIRS", 50), ("WORDS", 20), ("COUNTED", 60)):
        monkeypatch.setattr(mixing, name, n)
    got = mixing.scored(docs, range_words=60, frequent=10).collect()
    table = mixing.written(mixing.word_counts(mixing.chunked(docs, "doc_id", "text", 7)), "counts")
    value = {r["id"]: r["score"] for r in mixing.word_scores(mixing.fit(table, 60)).collect()}
    single, pair, lists = Counter(), Counter(), []
    for key, t in rows:
        found = [None, *mixing.tokens(t or "")]
        held = zlib.crc32(("null" if key is None else str(key)).encode()) % 7 == 2
        lists.append((key, found, held))
        if not held:
            single.update(found)
            pair.update(zip(found, found[1:], strict=False))
    follows = Counter()
    for (v, _), n in pair.items():
        follows[v] += n
    assert all(follows[v] == n for v, n in single.items() if v != mixing.END)  # so the shares of a context sum to one
    (counts, weight), own = learned[0], {w: 10 ** value[mixing.identity(w)] for _, found, _ in lists for w in found[1:]}
    ratios = []
    expected = []
    for key, found, held in lists:
        total = 0.0
        for v, w in zip(found, found[1:], strict=False):
            n = single[v]
            share = weight[min(int(math.log2(n)), 23)] if n else 0.0
            total += math.log10((share * pair[v, w] / n if n else 0.0) + (1 - share) * own[w])
            if not held and n > 1:
                ratios.append((min(int(math.log2(n - 1)), 23), (pair[v, w] - 1) / (n - 1) / own[w]))
        expected.append((key, len(found) - 1, total))
    order = lambda x: (str(x[0]), x[2])
    for a, b in zip(sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in got), key=order), sorted(expected, key=order), strict=True):
        assert a[:2] == b[:2] and np.isclose(a[2], b[2])
    # every training occurrence with a word before it that occurs elsewhere has taught, and the weights are the likeliest
    assert counts.sum() == len(ratios) and weight.max() > 0.1
    for gate in range(8):
        mine = np.array([r for g, r in ratios if g == gate])
        if len(mine):
            grid = np.linspace(0, 0.999, 400)
            best = grid[np.argmax([np.log1p(x * (mine - 1)).sum() for x in grid])]
            assert abs(best - weight[gate]) < 0.02


def test_sorting_by_place():
    draw = np.random.default_rng(3)
    for x in (draw.integers(0, 1 << 63, 500).astype(np.uint64), draw.integers(0, 40, 500).astype(np.uint64), np.zeros(1, np.uint64), (np.arange(64, dtype=np.uint64)[::-1] % np.uint64(5)) + np.uint64(1 << 60)):
        distinct, first, place = mixing.placed(x)
        told = np.unique(x, return_inverse=True)
        assert (distinct == told[0]).all() and (place == told[1]).all() and (x[first] == distinct).all()
