"""Scalar cleaning and report-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals_label(col: Column, positive) -> Column:
    """1 where the value equals ``positive``, else 0; NULL counts as 0."""
    return F.coalesce((col == F.lit(positive)).cast("int"), F.lit(0))


def strip_character(col: Column, character: str) -> Column:
    return F.replace(col, F.lit(character), F.lit(""))


def display_name(col: Column, names: dict[str, str]) -> Column:
    """Mapped value, or the value itself where the mapping has none."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col], col) if pairs else col


def gate_status(status: Column) -> Column:
    """UNSAT → PASS, SAT → FAIL, anything else (NULL too) → WARNING."""
    s = F.upper(status)
    return F.when(s == "UNSAT", "PASS").when(s == "SAT", "FAIL").otherwise("WARNING")


def pair_text(source: Column, target: Column) -> Column:
    """``source -> target``; NULL as soon as one side is missing."""
    return F.concat(source, F.lit(" -> "), target)


def _plain_double(text: Column) -> Column:
    # Java also parses "1d" and "1f"; those are not numbers here.
    return F.when(~F.lower(text).rlike("[0-9.][df]$"), text.try_cast("double"))


def parse_number(value: Column) -> Column:
    """Double from plain text or ``num/den``; NULL where that is not possible."""
    text = F.trim(value.cast("string"))
    top = F.trim(F.substring_index(text, "/", 1))
    bottom = F.trim(F.substring(text, F.instr(text, "/") + 1, F.length(text)))
    return F.when(text.contains("/"), F.try_divide(_plain_double(top), _plain_double(bottom))).otherwise(
        _plain_double(text)
    )


def normalise_prediction(value: Column) -> Column:
    """``0``/``1`` for anything that reads as 0 or 1, else the trimmed text."""
    text = F.trim(value.cast("string"))
    number = _plain_double(text)
    return F.when(number == 0.0, "0").when(number == 1.0, "1").otherwise(text)


def first_keyword(col: Column, table: list[tuple[str, str]], fallback: str) -> Column:
    """Text of the first table row whose keyword occurs in the column, ignoring case."""
    low = F.lower(col)
    result = None
    for keyword, text in table:
        hit = low.contains(keyword.lower())
        result = F.when(hit, F.lit(text)) if result is None else result.when(hit, F.lit(text))
    return F.lit(fallback) if result is None else result.otherwise(F.lit(fallback))


def category_rank(col: Column, order: list[str]) -> Column:
    """Position of a value in a custom order; NULL for values outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), col), F.lit(0).cast("bigint"))


def example_diff(x: Column, y: Column) -> Column:
    """Features whose values differ between two ``map<string,string>`` examples, in key order.

    A key that only one side has counts with NULL on the other; a NULL example gives an empty list.
    """
    keys = F.array_sort(F.array_union(F.map_keys(x), F.map_keys(y)))
    changed = F.filter(keys, lambda k: ~x[k].eqNullSafe(y[k]))
    rows = F.transform(
        changed, lambda k: F.struct(k.alias("feature"), x[k].alias("value_x"), y[k].alias("value_y"))
    )
    return F.coalesce(rows, F.array().cast("array<struct<feature:string,value_x:string,value_y:string>>"))


def diff_text(diff: Column) -> Column:
    """``feature: a -> b; …`` of an :func:`example_diff` list; a missing value reads ``None``."""
    return F.array_join(
        F.transform(
            diff,
            lambda d: F.concat(
                d["feature"],
                F.lit(": "),
                F.coalesce(d["value_x"], F.lit("None")),
                F.lit(" -> "),
                F.coalesce(d["value_y"], F.lit("None")),
            ),
        ),
        "; ",
    )
