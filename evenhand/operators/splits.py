"""Train/test splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.hashing import HASH_RANGE, row_hash

# 32 hash bits in three steps of at most 11 bits
SHIFTS = (21, 10, 0)


def hash_split(
    df: DataFrame, row_id: str, test_share: float, seed: int = 42, portable: bool = False, to: str = "split"
) -> DataFrame:
    """Map-only split: a row is a test row when its hash lies below the share.

    The hash does not depend on the label, so every label is split in the same proportion up to
    sampling error.
    """
    limit = int(round(test_share * HASH_RANGE))
    h = row_hash(seed, F.col(row_id), portable)
    return df.withColumn(to, F.when(h < F.lit(limit), "test").otherwise("train"))


def test_sizes(counts: dict, test_share: float) -> dict:
    """Test rows per label: the rounded-up total, shared out by largest remainder."""
    total = sum(counts.values())
    wanted = math.ceil(round(total * test_share, 9))
    exact = {k: wanted * n / total for k, n in counts.items()}
    sizes = {k: int(v) for k, v in exact.items()}
    left = wanted - sum(sizes.values())
    for k in sorted(exact, key=lambda k: (-(exact[k] - sizes[k]), k))[:left]:
        sizes[k] += 1
    return sizes


def exact_stratified_split(
    df: DataFrame,
    row_id: str,
    label: str,
    test_share: float,
    seed: int = 42,
    portable: bool = False,
    to: str = "split",
) -> DataFrame:
    """Split with exact test counts per label.

    Per label the rows with the smallest (hash, row id) are the test rows. The cut value comes from
    three rounds of bucket counts; rows are then compared with the cut, so the labelling itself
    needs no shuffle and no sort even though there are only two labels.
    """
    h = row_hash(seed, F.col(row_id), portable)
    hashed = df.select(F.col(label).alias("_label"), F.col(row_id).alias("_id"), h.alias("_h")).filter(
        "_label is not null"
    )
    level = _count_prefixes(hashed, SHIFTS[0])
    sizes = test_sizes({k: sum(buckets.values()) for k, buckets in level.items()}, test_share)
    # per label: the hash prefix that holds the last test row, and the rows below that prefix
    cuts = {k: _walk(level[k], n, 0) for k, n in sizes.items() if n}
    for previous, shift in zip(SHIFTS, SHIFTS[1:]):
        prefix = F.shiftright("_h", previous)
        inside = F.lit(False)
        for k, (bucket, _, _) in cuts.items():
            inside = inside | ((F.col("_label") == F.lit(k)) & (prefix == F.lit(bucket)))
        level = _count_prefixes(hashed.filter(inside), shift)
        cuts = {k: _walk(level[k], sizes[k], below) for k, (_, below, _) in cuts.items()}
    is_test = F.lit(False)
    for k, (cut, below, at) in cuts.items():
        chosen = h <= F.lit(cut)
        if sizes[k] - below < at:
            # several rows share the 32-bit hash at the cut: the smallest ids of that handful
            same = hashed.filter((F.col("_label") == F.lit(k)) & (F.col("_h") == F.lit(cut)))
            last = same.orderBy("_id").limit(sizes[k] - below).agg(F.max("_id")).first()[0]
            chosen = (h < F.lit(cut)) | ((h == F.lit(cut)) & (F.col(row_id) <= F.lit(last)))
        is_test = is_test | ((F.col(label) == F.lit(k)) & chosen)
    return df.withColumn(to, F.when(F.coalesce(is_test, F.lit(False)), "test").otherwise("train"))


def _count_prefixes(hashed: DataFrame, shift: int) -> dict:
    """Rows per label and hash prefix; at most 2,048 prefixes per label come back."""
    counted = hashed.groupBy("_label", F.shiftright("_h", shift).alias("prefix")).agg(F.count("*").alias("n"))
    out: dict = {}
    for r in counted.collect():
        out.setdefault(r["_label"], {})[r["prefix"]] = r["n"]
    return out


def _walk(buckets: dict, wanted: int, below: int) -> tuple[int, int, int]:
    """The prefix in which the running count reaches ``wanted``, the count before it and in it."""
    for prefix in sorted(buckets):
        if below + buckets[prefix] >= wanted:
            return prefix, below, buckets[prefix]
        below += buckets[prefix]
    raise ValueError("fewer rows than wanted test rows")
