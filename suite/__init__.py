"""Audit queries over the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib

from suite import registry

MODULES = ("cleaning", "preparing", "scoring", "probing", "pairs", "reporting")


def all_queries() -> dict:
    for name in MODULES:
        importlib.import_module(f"suite.{name}")
    return dict(registry.QUERIES)
