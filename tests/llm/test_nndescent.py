from __future__ import annotations

import numpy as np

from evenhand.llm import nndescent


def brute(rows, threshold=0.98):
    ok = {}
    for k, (i, e, label) in enumerate(rows):
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        v = np.array(e, float)
        ok[k] = (v / np.linalg.norm(v), label)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return [(r[0], links[k], least.get(root(k)), r[0] is None or least[root(k)] == r[0]) for k, r in enumerate(rows)]


def sample():
    rng = np.random.default_rng(4)
    rows = []

    def add(v, label):
        rows.append((len(rows), [float(x) for x in v], label))

    for label in range(3):
        for v in rng.standard_normal((60, 24)).astype(np.float32):
            add(v, label)
    for size in (2, 3, 9, 40):  # groups of near copies, one far beyond a list's length
        base = rng.standard_normal(24)
        for _ in range(size):
            add(base + 0.02 * rng.standard_normal(24), 1)
    chain = rng.standard_normal(24)  # linked one after the other only
    step = 0.15 * np.linalg.norm(chain) * np.eye(24)
    for k in range(4):
        add(chain + k * step[3], 2)
    for _ in range(40):  # equal vectors
        rows.append((len(rows), rows[7][1], 0))
    add(np.array(rows[7][1]) * 3, 0)
    rows.extend([(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, rows[7][1], None), (1004, [1.0, 2.0], 1), (1005, [1.0, 2.0], 1), (1006, [None] * 24, 1)])
    return rows


def test_rows(spark):
    rows = sample()
    data = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    got = nndescent.grouped(data).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert nndescent.grouped(data.limit(0)).count() == 0
    alone = nndescent.grouped(data.where("vec_id = 1000")).collect()
    assert [tuple(r) for r in alone] == [(1000, 0, 1000, True)]


def test_audit_measures_what_is_missing(spark):
    rows = [r for r in sample() if r[0] < 234]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = nndescent.nodes_of(data, "vec_id", "embedding", "label").withColumnRenamed("vec_id", "own").cache()
    links = nndescent.neighbour_links(nodes).cache()
    assert nndescent.audit(links, nodes, 0.98, 2000) == 1
    assert nndescent.audit(links.where("u > 190 and v > 190"), nodes, 0.98, 2000) < 1


def pairs_beside_a_large_group():
    """Unrelated vectors, isolated pairs just above the threshold, and a group whose links outnumber theirs."""
    rng = np.random.default_rng(8)
    rows = [v for v in rng.standard_normal((1500, 64))]
    for _ in range(60):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        rows += [a, 0.981 * a + np.sqrt(1 - 0.981**2) * b]
    rows += list(rng.standard_normal(64) + 0.02 * rng.standard_normal((150, 64)))
    return [(k, [float(x) for x in v], 1) for k, v in enumerate(rows)]


def test_isolated_pairs_are_not_lost_beside_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "TABLES", 1)
    rows = pairs_beside_a_large_group()
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = nndescent.grouped(data).collect()
    assert {r["vec_id"]: r["n_links"] for r in got if r["n_links"] == 1} == {k: 1 for k in range(1500, 1620)}


def test_blocks_find_every_link(spark):
    rows = [r for r in sample() if r[0] < 234]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = nndescent.nodes_of(data, "vec_id", "embedding", "label").withColumnRenamed("vec_id", "own").cache()
    whole = {tuple(r) for r in nndescent.block_links(nodes, 0.98).collect()}
    parts = [tuple(r) for r in nndescent.block_links(nodes, 0.98, values=24 * 30).collect()]
    assert len(parts) == len(whole) and set(parts) == whole
    counts = {r[0]: r[1] for r in brute(rows)}
    assert all(sum(u == k for u, _ in whole) == n for k, n in counts.items())


def test_links_of_a_large_group_are_counted_and_not_stored(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK_VALUES", 64 * 300)
    rng = np.random.default_rng(9)
    near = rng.standard_normal(64) + 0.02 * rng.standard_normal((200, 64))
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate([*near, *near[:5], *rng.standard_normal((300, 64))])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = nndescent.nodes_of(data, "vec_id", "embedding", "label").withColumnRenamed("vec_id", "own").dropDuplicates(["node"]).cache()
    # an entry of a list is a link in both directions
    assert nndescent.descent(nodes).count() <= 2 * nndescent.K * len(rows)
    made = []
    sums = nndescent.block_sums
    monkeypatch.setattr(nndescent, "block_sums", lambda *a: made.append(sums(*a)) or made[-1])
    assert sorted(map(tuple, nndescent.grouped(data).collect())) == sorted(brute(rows))
    assert made[0][0].count() == 200
    # what the rounds leave out is found by the blocks
    monkeypatch.setattr(nndescent, "descent", lambda n, *_: n.limit(0).select(n.node.alias("u"), n.node.alias("v")))
    assert sorted(map(tuple, nndescent.grouped(data).collect())) == sorted(brute(rows))
