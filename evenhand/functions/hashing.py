"""Seeded 32-bit hashes used for splits and draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def portable_hash(seed: int, key: Column) -> Column:
    """First 32 bits of ``md5("seed:key")``; any SQL engine can compute the same value."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def fast_hash(seed: int, key: Column) -> Column:
    """Upper 32 bits of xxhash64; cheaper, for use inside Spark only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 32)


def row_hash(seed: int, key: Column, portable: bool = False) -> Column:
    return portable_hash(seed, key) if portable else fast_hash(seed, key)
