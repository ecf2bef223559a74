"""Projection, filtering and cleaning of raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions import text


def drop_columns(df: DataFrame, label: str, leakage: tuple[str, ...] = ()) -> DataFrame:
    """Feature columns only: the label goes, and so do leakage columns where present."""
    return df.drop(label, *leakage)


def blind(df: DataFrame, sensitive: str, proxies: tuple[str, ...] = ()) -> DataFrame:
    """Model inputs without the sensitive column (and, on request, its proxies)."""
    return df.drop(sensitive, *proxies)


def binarise(df: DataFrame, source: str, positive, to: str = "label") -> DataFrame:
    return df.withColumn(to, text.equals_label(F.col(source), positive))


def drop_missing_label(df: DataFrame, label: str) -> DataFrame:
    return df.dropna(subset=[label])


def add_if_absent(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant column unless the table already has it."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def keep(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals a value; text compares without case."""
    if isinstance(value, str):
        return df.filter(F.upper(F.col(column)) == value.upper())
    return df.filter(F.col(column) == F.lit(value))


def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select and rename: output name by source name, in the given order."""
    return df.select(*[F.col(src).alias(dst) for src, dst in columns.items()])


def order_by_categories(df: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Sort by custom category orders; unknown categories come last."""
    return df.orderBy(*[text.category_rank(F.col(c), o).asc_nulls_last() for c, o in orders.items()])


def score_distance(x: Column, y: Column) -> Column:
    """Absolute difference of the two scores of a pair."""
    return F.abs(y - x)
