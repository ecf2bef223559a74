from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evenhand.llm import vafile


def brute(rows, k=5):
    v = {i: [int(np.floor(256 * float(x))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in (i for i in v if i % 50 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q])))
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vafile, "QUERIES", 2)
    monkeypatch.setattr(vafile, "VECTORS", 60)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[40:120] = x[50]  # one vector many times
    x[200:260] = np.round(x[200:260])  # ties
    rows = [(i, x[i].tolist()) for i in range(300)]
    rows += [(300, None), (350, [float("nan")] * 8), (400, [None] + [0.0] * 7), (450, [float("inf")] * 8), (500, [0.0] * 8), (550, [1.0, 2.0]), (551, [2.0, 2.0]), (None, [1.0] * 8)]
    data = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, score string")
    got = vafile.search(data, F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    # repeated rows count once
    again = vafile.search(data.union(data), F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, again)) == brute(rows)
    assert vafile.search(data.limit(0), F.col("id") % 50 == 0).count() == 0
    assert vafile.search(data.where("vec_id = 500"), F.col("id") % 50 == 0).count() == 0
