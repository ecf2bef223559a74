from __future__ import annotations

import math
import random
import statistics
import struct
import sys

import pytest
from pyspark.sql import functions as F

from evenhand.operators import ranks, splits


def test_order_statistics_match_sorting(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        rows.append((
            rng.randint(-5, 5),
            rng.choice([-(2**62), -1, 0, 2**62, rng.randint(-(2**40), 2**40)]),
            rng.choice([0.1, -1e300, 1e300, rng.gauss(0, 1), 1e-300 * rng.random()]),
            None if i % 3 else rng.random(),
        ))
    df = spark.createDataFrame(rows, "a int, b bigint, c double, d double")
    wanted = {}
    for i, c in enumerate("abcd"):
        values = sorted(r[i] for r in rows if r[i] is not None)
        wanted[c] = {k: values[k] for k in (0, 1, len(values) // 2, len(values) - 1)}
    found = ranks.order_statistics(df, {c: list(ks) for c, ks in wanted.items()})
    assert found == wanted


def test_rank_out_of_range(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    with pytest.raises(ValueError):
        ranks.order_statistics(df, {"a": [5]})


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 10.0], [3.0], [1.0, None, 2.0], [5.0, 5.0, 5.0, 5.0], [None, None]])
def test_medians_agree(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = [v for v in values if v is not None]
    assert ranks.exact_medians(df, ["x"], {"x": len(known)}) == {"x": statistics.median(known) if known else None}


EDGES = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 0.1, 1e300, math.inf, -math.inf, sys.float_info.max]


def test_keys_are_the_bits_of_a_double(spark):
    rng = random.Random(2)
    powers = [2.0**e for e in range(-1074, 1024)]
    values = EDGES + powers + [math.nextafter(p, 0) for p in powers] + [math.nextafter(p, math.inf) for p in powers]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", F.expr(ranks.ordered_key("x", False)).alias("k")).collect()
    for r in got:
        bits = struct.unpack("<Q", struct.pack("<d", abs(r["x"])))[0]
        assert r["k"] == (-bits if r["x"] < 0 else bits), r["x"]
        assert ranks.value_of_key(r["k"], False) == r["x"]


def test_number_of_passes_over_all_decades(spark):
    rng = random.Random(9)
    decades = [rng.choice([-1, 1]) * rng.uniform(1, 10) * 10.0**e for e in range(-305, 305) for _ in range(6)]
    close = [1.0 + i * 2.0**-52 for i in range(3000)]
    whole = [rng.choice([-1, 1]) * rng.getrandbits(63) for _ in range(3000)]
    rows = list(zip(decades[:3000], close, whole, strict=True))
    df = spark.createDataFrame(rows, "a double, b double, c bigint")
    passes: list = []
    found = ranks.order_statistics(df, {c: [0, 1234, 1500, 2999] for c in "abc"}, passes)
    for i, c in enumerate("abc"):
        values = sorted(r[i] for r in rows)
        assert found[c] == {k: values[k] for k in (0, 1234, 1500, 2999)}
    assert len(passes) <= ranks.MOST_PASSES == 6
    more = df.union(df.selectExpr("a * 3", "b", "c")).union(df)
    again: list = []
    ranks.order_statistics(more, {"a": [0, 4000]}, again)
    assert len(again) <= 6


def test_nan_and_missing_are_no_values(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None), (None, 3), (1.0, 2)], "x double, n int")
    assert ranks.order_statistics(df, {"x": [0, 1], "n": [2]}) == {"x": {0: 1.0, 1: 2.0}, "n": {2: 3}}
    with pytest.raises(ValueError):
        ranks.order_statistics(df, {"x": [2]})
    assert ranks.order_statistics(df, {"x": []}) == {}


def test_dense_index_with_repeated_leading_key(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).alias("k"), (F.col("id") % 3 > 0).alias("hot"))
    got = {(r["hot"], r["k"]): r["row_index"] for r in ranks.dense_index(df, ["hot", "k"]).collect()}
    assert [got[key] for key in sorted(got)] == list(range(5000))


def test_split_sizes_by_largest_remainder():
    assert splits.test_sizes({1: 700, 2: 300}, 0.3) == {1: 210, 2: 90}
    assert splits.test_sizes({0: 3, 1: 4}, 0.2) == {0: 1, 1: 1}
    assert splits.test_sizes({0: 10}, 0.0) == {0: 0}


@pytest.mark.parametrize("portable", [True, False])
def test_exact_split_counts(spark, portable):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    out = splits.exact_stratified_split(df, "id", "y", 0.3, portable=portable)
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts == {(0, "test"): 210, (0, "train"): 490, (1, "test"): 90, (1, "train"): 210}
    again = splits.exact_stratified_split(df.repartition(5), "id", "y", 0.3, portable=portable)
    assert out.filter("split = 'test'").exceptAll(again.filter("split = 'test'")).count() == 0


def test_exact_split_with_equal_hashes(spark, monkeypatch):
    """Rows that share one hash value are told apart by their id."""
    monkeypatch.setattr(splits, "row_hash", lambda seed, key, portable=False: (key % 2).cast("bigint"))
    df = spark.range(20).select(F.col("id"), F.lit(1).alias("y"))
    out = splits.exact_stratified_split(df, "id", "y", 0.25)
    assert sorted(r["id"] for r in out.filter("split = 'test'").collect()) == [0, 2, 4, 6, 8]
