from __future__ import annotations

from collections import Counter

import numpy as np

from evenhand.llm import bagminhash, graph


def bag(text, width=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else Counter()


def brute(rows, threshold=0.8):
    """Class of every row: least key (None last) over the components of equal and similar texts."""
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            x, y = bag(a), bag(b)
            common = sum((x & y).values())
            if common and common >= threshold * (x.total() + y.total() - common):
                parent[root(a)] = root(b)
    least = {}
    for key, t in rows:
        r = root(t or "")
        least[r] = min(least.get(r, (True, None)), (key is None, key), key=lambda x: (x[0], x[1] or 0))
    return [(key, least[root(t or "")][1]) for key, t in rows]


def test_signatures_are_unbiased():
    draw = np.random.default_rng(7)
    errors = []
    for k in range(40):
        one = [str(x) for x in draw.integers(0, 40, 200)] + ["x"] * int(draw.integers(0, 90))
        other = list(one)
        for at in draw.integers(0, len(one), 10):
            other[at] = "y" + str(at)
        other += ["x"] * int(draw.integers(0, 60))
        texts = [" ".join(one), " ".join(other)]
        owner, keys, weight = bagminhash.Shingler().bags(texts)
        values = bagminhash.signatures(owner, keys, weight, 2, 1024)
        x, y = map(bag, texts)
        true = sum((x & y).values()) / sum((x | y).values())
        own = bagminhash.similarity((keys[owner == 0], weight[owner == 0]), (keys[owner == 1], weight[owner == 1]))
        assert np.isclose(own, true)
        errors.append((values[0] == values[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.008 and np.std(errors) < 0.03


def sample():
    draw = np.random.default_rng(3)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for group in range(6):
        base = [words[k] for k in draw.integers(0, 500, 120)]
        for copy in range(int(draw.integers(1, 8))):
            text = list(base)
            for at in draw.integers(0, 120, copy):  # from exact copies to texts below the threshold
                text[at] = f"c{group}{copy}"
            rows.append((len(rows), " ".join(text)))
    hot = [words[k] for k in draw.integers(0, 500, 150)]
    for k in range(30):  # one large group of near copies
        rows.append((len(rows), " ".join([*hot[:-1], f"end{k}"])))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (1004, "one"), (None, "w w " * 300), (1005, "w w " * 300), (None, rows[0][1]), (0, rows[0][1])]
    rows += [(1006, "spam " * 400), (1007, "spam " * 380), (1008, "spam " * 200)]
    return rows


def test_rows(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, b"n", 1) for r in rows], "doc_id long, text string, node binary, class_id int")
    got = [(r["doc_id"], r["class_id"]) for r in bagminhash.grouped(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    kept = bagminhash.deduplicated(docs)
    assert kept.columns == docs.columns
    classes = dict((k, c) for k, c in brute(rows) if k is not None)
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(found) == sorted(set(classes.values()))
    assert bagminhash.grouped(docs.limit(0)).count() == 0


def test_buckets_with_several_components_are_gone_through(spark, monkeypatch):
    # every text shares every bucket: only verification tells them apart
    monkeypatch.setattr(bagminhash, "LEADERS", 5)
    monkeypatch.setattr(bagminhash, "MEMBERS_PER_LEADER", 3)
    rows = [r for r in sample() if r[1]][:14]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    import pyarrow as pa

    def same(texts, *_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[1, 2]] * b.num_rows, pa.list_(pa.int64()))], names=["node", "bands"])

        return texts.select("node", "text").mapInArrow(run, "node binary, bands array<long>")

    monkeypatch.setattr(bagminhash, "banded", same)
    got = [(r["doc_id"], r["class_id"]) for r in bagminhash.grouped(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (200, 200), (101, 100)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_components_are_not_dealt_over_all_partitions(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "a long, b long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = graph.components(links)
        assert found.rdd.getNumPartitions() == 1
        assert {(r["node"], r["component"]) for r in found.collect()} == {(k, 1) for k in range(1, 41)}
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_a_bucket_of_unlike_texts_takes_few_rounds(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bagminhash, "LEADERS", 2)
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(8))) for k in range(30)], "doc_id long, text string").coalesce(1)

    def same(texts, *_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[1]] * b.num_rows, pa.list_(pa.int64()))], names=["node", "bands"])

        return texts.select("node", "text").mapInArrow(run, "node binary, bands array<long>")

    rounds, several = [], bagminhash._several
    monkeypatch.setattr(bagminhash, "banded", same)
    monkeypatch.setattr(bagminhash, "rarest", lambda texts, *_: texts.selectExpr("7L as bucket", "node", "4L as size", "4L as rest"))
    monkeypatch.setattr(bagminhash, "_several", lambda *a: (rounds.append(1), several(*a))[1])
    got = {(r["doc_id"], r["class_id"]) for r in bagminhash.grouped(docs).collect()}
    assert got == {(k, k) for k in range(30)}
    assert len(rounds) <= 6


def test_rarest_shingles_bring_every_similar_pair_together(spark):
    # copies of one text with one to many changed words, a long text of repeats, and texts that share a passage only
    draw = np.random.default_rng(11)
    base = [f"w{k}" for k in draw.integers(0, 60, 150)]
    texts = []
    for copy in range(60):
        words = list(base)
        for at in draw.integers(0, 150, int(draw.integers(1, 9))):
            words[at] = f"x{copy}{at}"
        texts.append(" ".join(words))
    texts += [" ".join(["same", *base[:20], *(f"z{k}{j}" for j in range(40))]) for k in range(20)] + ["r s t " * 900, "r s t " * 800]
    data = spark.createDataFrame([(str(k).encode(), t) for k, t in enumerate(texts)], "node binary, text string")
    rows = bagminhash.rarest(data, 0.8, 5).collect()
    at = {}
    for r in rows:
        at.setdefault(r["bucket"], []).append((int(bytes(r["node"])), r["size"], r["rest"]))
    met = set()
    for members in at.values():
        for a, n, rest in members:
            for b, m, other in members:
                if a < b and min(rest, other) * 1.8 >= 0.8 * (n + m) - 1e-9:
                    met.add((a, b))
    bags = [bag(t) for t in texts]
    alike = {
        (a, b) for b in range(len(texts)) for a in range(b) if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())
    }
    assert len(alike) > 20 and alike <= met
    assert len(met) < 0.5 * len(texts) * (len(texts) - 1) / 2
