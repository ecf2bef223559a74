"""Small helpers to write expressions as text.

A model scored for every group is a few hundred operators; as text it is one ``expr`` call instead
of hundreds of calls into the JVM, and Catalyst sees the same tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

Lookup = Callable[[str], str]


def plain(name: str) -> str:
    """A column by its own name: the factual lookup."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    value = float(value)
    if math.isnan(value) or math.isinf(value):
        return f"double('{value}')"
    return f"{value!r}D" if value >= 0 else f"({value!r}D)"


def as_group(column: str, value: str, lookup: Lookup = plain) -> Lookup:
    """The same lookup with one column replaced: the counterfactual of a row.

    ``value`` is expression text, a :func:`literal` group or another column.
    """
    return lambda name: value if name == column else lookup(name)
