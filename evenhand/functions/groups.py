"""Expressions about sensitive groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_from_codes(col: Column, codes: dict[str, list[str]], fallback: str = "unknown") -> Column:
    """Map code sets to group names; everything else, NULL included, is ``fallback``."""
    result = None
    for name, members in codes.items():
        hit = col.isin(members)
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    return F.lit(fallback) if result is None else result.otherwise(F.lit(fallback))


def alternatives(groups: Column, current: Column) -> Column:
    """All groups but the row's own one. A NULL group keeps them all."""
    return F.array_except(groups, F.array(current.cast("string")))


def swapped(current: Column, first: Column, second: Column) -> Column:
    """Exchange two values and leave every other one (and NULL) as it is."""
    return F.when(current == first, second).when(current == second, first).otherwise(current)
