"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import packed, settled


def _stars(links: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step of alternating stars: every node's larger (or smaller) neighbours are linked to its least neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(links.select("b", "a")) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = packed(both, 2 * rows)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return packed(packed(out.where("a <> b"), 2 * rows).distinct(), rows)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b, stored): the least node that it reaches.

    Alternating large and small stars: each round is a few shuffles of the links, sums are made before them, and
    the number of rounds grows with the logarithm of the longest path; links that fit one partition are not shuffled
    at all. An empty table gives no rows.
    """
    links = links.select("a", "b").where("a <> b")
    now = settled(packed(links, links.count()).distinct())
    rows, before = now.count(), None
    now = packed(now, rows)
    while True:
        now = settled(_stars(_stars(now, True, rows), False, rows))
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    now = packed(now, rows)
    return packed(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()), 2 * rows)
