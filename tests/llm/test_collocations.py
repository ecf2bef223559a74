from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from evenhand.llm import collocations as C


def brute(rows, support, first=2000, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = {}
    for (lang, p), a in found.items():
        inside = any(
            q_lang == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (q_lang, q), b in found.items()
        )
        if not inside:
            s, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(docs, **options):
    got = C.collocations(docs, **options)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("support", [2, 5])
def test_equals_counting_all(spark, support):
    dice = random.Random(support)
    words = ["a", "B", "c", "d", "é", "日本", "it's", "-", "a b"]
    rows = []
    for i in range(60):
        text = "".join(dice.choice(words) + dice.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", ",\r"]) for _ in range(dice.randrange(40)))
        rows.append((i % 50, text if i % 9 else None, dice.choice(["en", "de", None, "und"]), "phrase", 1))
    rows += rows[:7]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n int").repartition(4)
    assert mined(docs, support=support) == brute([(r[2], r[1]) for r in rows], support)
    assert mined(docs, support=support, first=3) == brute([(r[2], r[1]) for r in rows], support, 3)


def test_empty_and_nothing_frequent(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (None, None, None), (2, "", "de")], "doc_id long, text string, lang string")
    assert mined(docs) == []
    assert mined(docs.limit(0)) == []
    assert mined(docs, support=1, longest=2) == brute([("en", "a b c")], 1, longest=2)


def test_long_text_is_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    import pyarrow as pa

    text = "a b c d. " * 40 + "x " * 200
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array([0, 1, 2], pa.int32()), pa.array(["a b", text, "c"])], names=["lang", "shard", "text"])
    parts = list(C._slices(batch, 64))
    assert len(parts) > 3
    assert sum(len(p.number) for p in parts) == 2 + 160 + 200 + 1
    assert any(len(p.number) == 200 or len(p.number) > 200 for p in parts)


def test_products_beyond_64_bits(spark):
    a, n, l, r = 9 * 10**15, 9 * 10**16, 10**16 + 7, 10**16 + 9
    row = spark.sql(
        f"select (1000 * cast({a}L as decimal(17,0)) * cast({n}L as decimal(17,0))) div (cast({l}L as decimal(19,0)) * cast({r}L as decimal(19,0))) as s"
    ).first()
    assert row["s"] == 1000 * a * n // (l * r)


def test_filter_has_all_its_keys(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5_000)
    made = C.BitFilter.of(spark.createDataFrame([(int(k),) for k in keys], "key long"), len(keys))
    assert made.has(keys.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 5_000).view(np.uint64)
    assert made.has(others).mean() < 0.1


@pytest.mark.parametrize("held, most", [(600_000, 12), (8, 12), (20, 5)])
def test_a_task_sums_its_slices(monkeypatch, held, most):
    import pyarrow as pa

    monkeypatch.setattr(C, "HELD_LINES", held)
    monkeypatch.setattr(C, "HELD_SUMS", most)
    words = [("en" if i % 2 else "de", i % 3, f"w{i}") for i in range(12)]
    names = ["lang", "words", "phrase", "n"]
    batch = lambda ws, n: pa.RecordBatch.from_arrays([pa.array([w[0] for w in ws]), pa.array([w[1] for w in ws], pa.int32()), pa.array([w[2] for w in ws]), pa.array([n] * len(ws))], names=names)
    made = [tuple(r.values()) for b in C._summed(batch(words[i % 4 :], i) for i in range(9)) for r in b.to_pylist()]
    sums = Counter()
    for *w, n in made:
        sums[tuple(w)] += n
    assert sums == {w: sum(i for i in range(9) if i % 4 <= k) for k, w in enumerate(words)}
    if most == 12:
        assert len(made) == 12
    assert list(C._summed(iter([]))) == []


def test_phrases_that_no_count_of_the_shards_lets_reach_the_support_are_no_candidates(spark):
    dice = random.Random(11)
    rows = [(i, " ".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)), "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shard = C.F.pmod(C.F.xxhash64("doc_id", "text"), C.F.lit(1 << C.SHARD_BITS)).cast("int").alias("shard")
    rows = docs.select("lang", shard, "text")
    known = C._mined(rows, 50, 2)[1]
    pairs, words = Counter(), Counter()
    for r in rows.collect():
        own = r["text"].split()
        words[r["shard"]] += len(own)
        pairs.update((p, r["shard"]) for p in zip(own, own[1:], strict=False))
    least = {k: -(-50 * n // words.total()) for k, n in words.items()}
    distinct = sorted({p for p, _ in pairs})
    at_most = np.array([sum(pairs[p, k] if pairs[p, k] >= m else m - 1 for k, m in least.items()) for p in distinct])
    found = np.array([any(pairs[p, k] >= m for k, m in least.items()) for p in distinct])
    part = C._Slice(C.pa.array(["\n".join(" ".join(p) for p in distinct)]), ["en"], np.zeros(1, int), np.zeros(1, int))
    part.prepare(sharded=False)
    at = np.flatnonzero(part.piece[1:] == part.piece[:-1])
    passed = known.has(part.keys(at, C._chain(part.hash[at], part.hash[at + 1])))
    assert passed[at_most >= 50].all() and (at_most >= 50).any()
    # before, all that a shard had found passed
    assert (found & (at_most < 50)).sum() > 100 and passed[found & (at_most < 50)].mean() < 0.05
