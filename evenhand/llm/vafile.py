"""Exact top-k inner-product search with vector-approximation files.

Every vector has an approximation: the cell of each component, a few bits. Queries, in blocks, scan the
approximations of all vectors, in blocks, for bounds of their scores. A vector whose upper bound is below the
k-th largest lower bound cannot be an answer. Exact vectors of the others are read in the order of their bounds:
first those at the head, then those whose upper bound still reaches the k-th exact score. Then the k-th result is
certain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import settled, shipped, written

BITS, K, SCALE = 6, 5, 256
#: Rows of a block of queries and of a block of approximations.
QUERIES, VECTORS = 1024, 16_384


def usable(vector: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def integers(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): usable vectors with each component x turned into floor(scale * x)."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).alias("id"), whole.alias("v"))


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, a: s + a)


def _scan(queries: pd.DataFrame, cells: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, point, approx) that one block of vectors cannot rule out for one block of queries."""
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "point": np.zeros(0, np.int64), "approx": np.zeros(0)})
    if not len(queries) or not len(cells):
        return empty
    low, step = np.array(cells["low"].iloc[0]), np.array(cells["step"].iloc[0])
    centre = np.frombuffer(b"".join(cells["cells"]), np.uint8).reshape(len(cells), -1) * step + (low + (step - 1) / 2)
    points, alone = cells["point"].to_numpy(), cells["alone"].to_numpy()
    out = []
    for at in range(0, len(queries), 128):
        part = queries.iloc[at : at + 128]
        q = np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), -1)
        ids = part["query_id"].to_numpy()
        score = q @ centre.T
        # a vector that only the query itself has is no candidate
        score[(points[None, :] == ids[:, None]) & alone[None, :]] = -np.inf
        slack = part["slack"].to_numpy()
        top = min(k, len(points)) - 1
        kth = -np.partition(-score, top, axis=1)[:, top]
        row, column = np.nonzero((score >= (kth - 2 * slack - 1e-6 * (1 + np.abs(kth)))[:, None]) & np.isfinite(score))
        out.append(pd.DataFrame({"query_id": ids[row], "point": points[column], "approx": score[row, column]}))
    return pd.concat(out) if out else empty


def search(
    rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, bits: int = BITS, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, <key>, score): for every query row the k highest integer inner products, ties to smaller keys.

    ``is_query`` is a condition on the key (as column ``id``). Vectors that are null or hold null or non-finite
    components, and rows with a null key, take no part; vectors are compared with those of equal length. Rows with
    the query's key are never its results; repeated rows count once. Fewer than k candidates give fewer rows, an
    empty table none. Other columns are left out.
    """
    spark = rows.sparkSession
    shipped(spark)
    vectors = written(integers(rows, key, vector, scale).distinct(), "vectors")
    # equal vectors are one point; of their keys only the k + 1 least can be results
    order = Window.partitionBy("v").orderBy("id")
    points = (
        vectors.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("dim", F.size("v"))
    )
    points = written(points, "points")
    ranges = (
        points.select("dim", F.posexplode("v").alias("at", "x"))
        .groupBy("dim", "at")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
        .groupBy("dim")
        .agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("r"))
    )
    # a cell holds ``step`` integers from ``low + step * cell``
    ranges = settled(
        ranges.select(
            "dim",
            F.transform("r", lambda x: x["low"]).alias("low"),
            F.transform("r", lambda x: F.floor((x["high"] - x["low"]) / 2**bits).cast("long") + 1).alias("step"),
        )
    )
    counted = vectors.where(is_query).count()
    query_blocks = max(1, -(-counted // QUERIES))
    vector_blocks = max(1, -(-points.count() // VECTORS))
    asked = (
        vectors.where(is_query)
        .withColumn("dim", F.size("v"))
        .join(ranges.select("dim", "step"), "dim")
        .select(
            F.col("id").alias("query_id"),
            "v",
            "dim",
            F.aggregate(F.zip_with("v", "step", lambda x, s: F.abs(x) * (s - 1) / 2), F.lit(0.0), lambda a, b: a + b).alias("slack"),
        )
    )
    asked = written(asked, "queries")
    # each block of queries meets each block of vectors: both sides are dealt over a grid
    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))).withColumn(
        "vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vector_blocks - 1).cast("long")))
    )
    cell = F.zip_with(F.zip_with("v", "low", lambda x, y: x - y), "step", lambda x, s: F.floor(x / s))
    code = F.unhex(F.array_join(F.transform(cell, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    right = (
        points.join(ranges, "dim")
        .select("point", "dim", "low", "step", code.alias("cells"), (F.size("ids") == 1).alias("alone"))
        .withColumn("vb", F.pmod(F.xxhash64("point"), F.lit(vector_blocks)))
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    )

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _scan(a, b, k)

    found = written(
        left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb")).applyInPandas(scan, "query_id long, point long, approx double"), "bounds"
    )
    bounded = found.join(asked.select("query_id", "slack", F.col("v").alias("q")), "query_id")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("approx"), "point")
    placed = bounded.withColumn("place", F.row_number().over(by_bound)).withColumn(
        "kth", F.max(F.when(F.col("place") == k, F.col("approx"))).over(Window.partitionBy("query_id"))
    )
    left_over = settled(placed.where(F.col("kth").isNull() | (F.col("approx") >= F.col("kth") - 2 * F.col("slack") - 1e-6 * (1 + F.abs("kth")))).drop("kth"))
    exact = points.select("point", "ids", "v")

    def read(some: DataFrame) -> DataFrame:
        return some.join(exact, "point").select("query_id", "point", "ids", _dot("q", "v").alias("score"))

    head = settled(read(left_over.where(F.col("place") <= 2 * k)))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    certain = head.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("query_id", F.col("score").alias("kth"))
    rest = left_over.where(F.col("place") > 2 * k).join(certain, "query_id").where(F.col("approx") + F.col("slack") + 1e-6 * (1 + F.abs("approx")) >= F.col("kth"))
    results = (
        head.union(read(rest))
        .select("query_id", "score", F.explode("ids").alias(key))
        .where(F.col(key) != F.col("query_id"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
        .where(F.col("rank") <= k)
    )
    return results.select("query_id", "rank", key, "score")
