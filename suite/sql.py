"""Building blocks of the oracle texts."""

from __future__ import annotations

import re

from suite.frames import FRAME_CTE
from suite.models import SQL_BLIND, SQL_MODELS

THREE = ("tree", "logreg", "rulelist")


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def groups(frame: str = "oa") -> str:
    return f"grp AS (SELECT DISTINCT s AS g FROM {frame} WHERE s IS NOT NULL)"


def own(frame: str = "oa", models: tuple[str, ...] = THREE, blind: bool = False, name: str = "own") -> str:
    """Every row scored as it is: (row_id, s, label, model, include_sensitive, score, proba, pred)."""
    texts = SQL_BLIND[frame] if blind else SQL_MODELS[frame]
    parts = []
    for m in models:
        t = {k: v.replace("{g}", "s") for k, v in texts[m].items()}
        parts.append(
            f"SELECT row_id, s, label, '{m}' AS model, {'FALSE' if blind else 'TRUE'} AS include_sensitive, "
            f"{t['score']} AS score, {t['proba']} AS proba, {t['pred']} AS pred FROM {frame}"
        )
    return f"{name} AS (" + "\n UNION ALL ".join(parts) + ")"


def pinned(frame: str = "oa", models: tuple[str, ...] = THREE) -> str:
    """Every row scored as a member of every group: adds g."""
    parts = []
    for m in models:
        t = {k: v.replace("{g}", "g") for k, v in SQL_MODELS[frame][m].items()}
        parts.append(
            f"SELECT row_id, s, label, g, '{m}' AS model, {t['score']} AS score, {t['proba']} AS proba, "
            f"{t['pred']} AS pred FROM {frame} CROSS JOIN grp"
        )
    return "pinned AS MATERIALIZED (" + "\n UNION ALL ".join(parts) + ")"


def frame(name: str = "oa") -> str:
    return FRAME_CTE[name]


def f1(prefix: str = "") -> str:
    tp = f"sum(CAST({prefix}label = 1 AND {prefix}pred = 1 AS INTEGER))"
    fp = f"sum(CAST({prefix}label = 0 AND {prefix}pred = 1 AS INTEGER))"
    fn = f"sum(CAST({prefix}label = 1 AND {prefix}pred = 0 AS INTEGER))"
    return f"COALESCE(2.0e0 * {tp} / NULLIF(2 * {tp} + {fp} + {fn}, 0), 0.0e0)"


ACCURACY = "avg(CAST(label = pred AS INTEGER))"

_LOCAL = "grp|own|blind|scored|pinned|draws|opts|chosen|rnd|near|bnd|det|prs|fst|wit|cells|qual|r"


def suffixed(text: str, mark: str, frame_name: str) -> str:
    """The same blocks for a second data set in one query: local names get a mark, and the orders
    frame is replaced by another one."""
    out = re.sub(rf"(?<![\w'.])({_LOCAL})(?=\b(?!'))", rf"\1{mark}", text)
    return re.sub(r"\boa\b", frame_name, out)
