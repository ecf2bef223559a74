"""Exact order statistics and dense row numbers without a single-task sort."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions.expressions import plain
from evenhand.session import shared_folder

DIGIT_BITS = 11
#: No search takes more passes than a 64-bit key has digits.
MOST_PASSES = -(-64 // DIGIT_BITS)
_TOP = 1 << 63


def ordered_key(value: str, integral: bool) -> str:
    """Expression text of a bigint in the order of the values.

    A whole number is its own key. A double's key are its bits, as sign and size: they are computed from its exponent
    and fraction, which is exact, because a power of two divides without rounding.
    """
    if integral:
        return f"CAST({value} AS BIGINT)"
    a, guess = f"abs({value})", f"floor(log2(abs({value})))"
    # the logarithm may be one off at a power of two
    exponent = f"CAST(CASE WHEN {a} < pow(2D, {guess}) THEN {guess} - 1 WHEN {a} >= pow(2D, {guess} + 1) THEN {guess} + 1 ELSE {guess} END AS BIGINT)"
    whole = f"CAST(({a} / pow(2D, {exponent}) - 1D) * {float(1 << 52)!r}D AS BIGINT)"
    size = (
        f"CASE WHEN {a} = 0D THEN 0L WHEN {a} = double('Infinity') THEN {2047 << 52}L "
        f"WHEN {a} < 2.2250738585072014E-308D THEN CAST({a} * {2.0**537!r}D * {2.0**537!r}D AS BIGINT) "
        f"ELSE ({exponent} + 1023L) * {1 << 52}L + {whole} END"
    )
    return f"CASE WHEN {value} < 0D THEN -({size}) ELSE {size} END"


def value_of_key(key: int, integral: bool) -> int | float:
    if integral:
        return key
    size = struct.unpack("<d", struct.pack("<Q", abs(key)))[0]
    return -size if key < 0 else size


def order_statistics(df: DataFrame, targets: dict[str, list[int]], passes: list | None = None) -> dict[str, dict[int, float]]:
    """The k-th smallest (0-based) non-null value of numeric columns, exactly; NaN is no value.

    Radix selection over ordered keys. Every pass counts the still possible values of all columns by the next 11 bits
    in which they can differ (one partially aggregated job; at most 2,048 lines a search come back), and keeps the
    bucket that holds the wanted rank, with its least and largest key. So there are at most six passes, whatever the
    values and however many, and fewer where a bucket holds one value. ``passes``, if given, receives an entry per pass.
    """
    columns = [c for c, ks in targets.items() if ks]
    if not columns:
        return {}
    integral = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    numbered = {c: f"_k{i}" for i, c in enumerate(columns)}

    def key(c: str) -> Column:
        raw = plain(c) if c in integral else f"nullif(CAST({plain(c)} AS DOUBLE), double('NaN'))"
        return F.expr(raw)

    values = df.select(*[key(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    keys = values.select(*[F.expr(ordered_key(f"_v{i}", c in integral)).alias(numbered[c]) for i, c in enumerate(columns)])
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    # open searches: (column, wanted rank, values below the interval, least and largest key)
    searches = [(c, k, 0, -_TOP, _TOP - 1) for c in columns for k in sorted(set(targets[c]))]
    while searches:
        intervals = sorted({(c, below, lo, hi) for c, _, below, lo, hi in searches})
        slots = []
        for i, (c, _, lo, hi) in enumerate(intervals):
            # both ends share the bits above those in which they differ
            shift = max(((lo ^ hi) & (2 * _TOP - 1)).bit_length() - DIGIT_BITS, 0)
            name = numbered[c]
            digit = F.shiftrightunsigned(F.col(name).bitwiseXOR(F.lit(-_TOP)), shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            inside = F.col(name).between(F.lit(lo), F.lit(hi))
            slots.append(F.struct(F.lit(i).alias("search"), F.when(inside, digit).alias("digit"), F.col(name).alias("key")))
        counted = (
            keys.select(F.inline(F.array(*slots)))
            .filter("digit is not null")
            .groupBy("search", "digit")
            .agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        )
        histogram: dict[int, list] = {}
        for r in counted.collect():
            histogram.setdefault(r["search"], []).append(r)
        if passes is not None:
            passes.append(len(searches))
        left = []
        for c, k, below, lo, hi in searches:
            seen = below
            for r in sorted(histogram.get(intervals.index((c, below, lo, hi)), []), key=lambda r: r["lo"]):
                if k < seen + r["n"]:
                    if r["lo"] == r["hi"]:
                        found[c][k] = value_of_key(r["lo"], c in integral)
                    else:
                        left.append((c, k, seen, r["lo"], r["hi"]))
                    break
                seen += r["n"]
            else:
                raise ValueError(f"rank {k} is beyond the {seen} values of {c}")
        searches = left
    return found


def exact_medians(df: DataFrame, columns: list[str], counts: dict[str, int]) -> dict[str, float | None]:
    """Interpolated medians of columns with ``counts`` values each, None without a value."""
    wanted = {c: sorted({(counts[c] - 1) // 2, counts[c] // 2}) for c in columns if counts[c]}
    found = order_statistics(df, wanted)
    middle = {c: (float(found[c][ks[0]]) + float(found[c][ks[-1]])) / 2 for c, ks in wanted.items()}
    return {c: middle.get(c) for c in columns}


def dense_index(df: DataFrame, keys: list[str], name: str = "row_index") -> DataFrame:
    """Number rows 0…n−1 in key order.

    One range shuffle sorts the rows and a reliable checkpoint fixes the partition of every row;
    the number is then the row's place in its partition plus the sizes of the partitions before it
    (one row per partition, so that table is small by construction).
    """
    shared_folder(df.sparkSession)
    sorted_rows = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    ).checkpoint()
    part = F.shiftrightunsigned(F.col("_place"), 33)
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    starts = sizes.selectExpr(
        "_part as _start_part", "sum(_size) over (order by _part) - _size as _start"
    )
    return (
        sorted_rows.join(F.broadcast(starts), part == F.col("_start_part"))
        .withColumn(name, (F.col("_start") + place).cast("bigint"))
        .drop("_place", "_start", "_start_part")
    )
