from __future__ import annotations

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from evenhand.llm import secrets, spans

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def listed(found):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)


def sample():
    draw = random.Random(3)
    pick = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    bits = ["password", "Token", "API_KEY", "apikey", '"', "'", " ", "  ", ":", "=", "abcdefgh", "short", "AKIA", "AKIAABCDEFGHIJKL", "é", "日本", "\n", "🙂", "0" * 31, "f" * 40, "x"]
    rows = [(k, "".join(draw.choice(bits) for _ in range(draw.randint(0, 30)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "AKIA" + "A" * 11), (203, "secret=12345678 " * 700), (None, "token: abcdefghij"), (None, "token: abcdefghij"), (5, rows[5][1])]
    alnum = string.ascii_letters + string.digits
    rows += [(300 + k, f"key {pick(alnum, 40)} end") for k in range(150)]
    rows += [(600 + k, f"see the-article-{k}-about-something-long-2024 now") for k in range(150)]
    return rows


def test_rows(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, n_hex int, base string")
    got = secrets.digests(secrets.scan(docs)).collect()
    expected = []
    for key, text in rows:
        found = base(text or "")
        counts = [sum(k == kind for _, k, _ in found) for kind in range(3)]
        expected.append((key, *counts, hashlib.sha256(listed(found).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    spans_of = {r["doc_id"]: r["spans"] for r in got}
    assert sum("random:4:44" == spans_of[300 + k] for k in range(150)) >= 130
    assert not any("random" in spans_of[600 + k] for k in range(150))
    assert secrets.digests(secrets.scan(docs.limit(0))).count() == 0


def test_battery_is_uniform_for_random_strings(spark):
    draw = random.Random(1)
    rows = [("".join(draw.choice(string.ascii_letters + string.digits) for _ in range(36)),) for _ in range(600)]
    tested = secrets.battery(spark.createDataFrame(rows, "token string"))
    low = tested.agg(F.avg((F.col("p") < 0.1).cast("int")), F.avg((F.col("p") < 0.5).cast("int"))).first()
    assert abs(low[0] - 0.1) < 0.05 and abs(low[1] - 0.5) < 0.08
    assert {r[0] for r in tested.select("encoding").distinct().collect()} == {"mixed"}


def test_prefix_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(F.array(*[F.lit(k).cast("long") for k in range(n)]).cast("array<bigint>").alias("x")).select(spans.running(F.col("x"))).first()[0]
        assert row == [k * (k - 1) // 2 for k in range(n)]
