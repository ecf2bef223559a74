"""Literal models over the audit frames, stated once for Spark and once for SQL.

In the SQL texts ``{g}`` stands for the group the row is pinned to.
"""

from __future__ import annotations

from evenhand.operators.features import CategoricalBlock, Encoder, NumericFeature
from evenhand.operators.scorers import LinearScorer, Node, Rule, RuleListScorer, TreeScorer

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
LANGS = ("de", "en", "es", "fr")

# ---- orders ------------------------------------------------------------------------------------
ORDERS_ENCODER = Encoder(
    (NumericFeature("o_totalprice", None, 250000.0, 144000.0), NumericFeature("c_acctbal", None, 4500.0, 3200.0)),
    (
        CategoricalBlock("o_orderstatus", ("F", "O", "P")),
        CategoricalBlock("r_name", REGIONS),
        CategoricalBlock("c_mktsegment", SEGMENTS),
    ),
)
_ORDERS_SHARED = {
    "o_totalprice": 0.9, "c_acctbal": -0.6,
    "o_orderstatus=F": 0.3, "o_orderstatus=O": -0.25,
    "r_name=AFRICA": 0.1, "r_name=ASIA": -0.15, "r_name=EUROPE": 0.2,
}
_SEGMENT_WEIGHTS = {
    "c_mktsegment=AUTOMOBILE": 0.12, "c_mktsegment=BUILDING": -0.2, "c_mktsegment=FURNITURE": 0.05,
    "c_mktsegment=HOUSEHOLD": -0.08, "c_mktsegment=MACHINERY": 0.2,
}
_EQUAL_WEIGHTS = {f"c_mktsegment={s}": 0.1 for s in SEGMENTS}

ORDERS_LOGREG = LinearScorer("logreg", ORDERS_ENCODER, {**_ORDERS_SHARED, **_SEGMENT_WEIGHTS}, -0.1)
ORDERS_EQUAL = LinearScorer("logreg_equal", ORDERS_ENCODER, {**_ORDERS_SHARED, **_EQUAL_WEIGHTS}, -0.1)
ORDERS_CATEGORICAL = LinearScorer(
    "logreg_categorical",
    ORDERS_ENCODER,
    {
        "o_orderstatus=F": 0.5, "o_orderstatus=O": -0.5, "o_orderstatus=P": 0.05,
        "r_name=AFRICA": 0.25, "r_name=AMERICA": -0.25, "r_name=ASIA": 0.75,
        **_SEGMENT_WEIGHTS,
    },
    -0.3,
)
ORDERS_LOGREG_BLIND = LinearScorer(
    "logreg", ORDERS_ENCODER.without("c_mktsegment"), _ORDERS_SHARED, -0.1, include_sensitive=False
)
ORDERS_RULES = RuleListScorer(
    "rulelist",
    ORDERS_ENCODER,
    (
        Rule((("c_mktsegment=BUILDING", ">", 0.5), ("o_totalprice", ">", 0.2)), 0, 0.3),
        Rule((("o_totalprice", ">", 0.8),), 1, 0.85),
        Rule((("c_acctbal", "<=", -0.5), ("o_orderstatus=O", ">", 0.5)), 1, 0.7),
        Rule((("c_mktsegment=MACHINERY", ">", 0.5), ("c_acctbal", ">", 1.0)), 1, 0.6),
    ),
    default=0,
)
ORDERS_RULES_BLIND = RuleListScorer(
    "rulelist",
    ORDERS_ENCODER.without("c_mktsegment"),
    (
        Rule((("o_totalprice", ">", 0.8),), 1, 0.85),
        Rule((("c_acctbal", "<=", -0.5), ("o_orderstatus=O", ">", 0.5)), 1, 0.7),
    ),
    default=0,
    include_sensitive=False,
)
ORDERS_TREE = TreeScorer(
    "tree",
    ORDERS_ENCODER,
    (
        Node(0, "o_totalprice", 0.1, 1, 2),
        Node(1, "c_mktsegment=HOUSEHOLD", 0.5, 3, 4),
        Node(2, "r_name=ASIA", 0.5, 7, 8),
        Node(3, n0=30, n1=10),
        Node(4, "c_acctbal", 0.0, 5, 6),
        Node(5, n0=5, n1=20),
        Node(6, n0=20, n1=20),
        Node(7, n0=10, n1=40),
        Node(8, "c_mktsegment=AUTOMOBILE", 0.5, 9, 10),
        Node(9, n0=25, n1=5),
        Node(10, n0=5, n1=25),
    ),
)
ORDERS_TREE_BLIND = TreeScorer(
    "tree",
    ORDERS_ENCODER.without("c_mktsegment"),
    (
        Node(0, "o_totalprice", 0.1, 1, 2),
        Node(1, n0=40, n1=20),
        Node(2, "r_name=ASIA", 0.5, 3, 4),
        Node(3, n0=10, n1=40),
        Node(4, n0=25, n1=5),
    ),
    include_sensitive=False,
)
ORDERS_MODELS = [ORDERS_TREE, ORDERS_LOGREG, ORDERS_RULES]
ORDERS_BLIND = [ORDERS_TREE_BLIND, ORDERS_LOGREG_BLIND, ORDERS_RULES_BLIND]

_Z_PRICE = "((o_totalprice - 250000.0e0) / 144000.0e0)"
_Z_BAL = "((c_acctbal - 4500.0e0) / 3200.0e0)"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 0.3e0 WHEN 'O' THEN -0.25e0 ELSE 0.0e0 END"
_REGION = "CASE r_name WHEN 'AFRICA' THEN 0.1e0 WHEN 'ASIA' THEN -0.15e0 WHEN 'EUROPE' THEN 0.2e0 ELSE 0.0e0 END"
_SEGMENT = (
    "CASE {g} WHEN 'AUTOMOBILE' THEN 0.12e0 WHEN 'BUILDING' THEN -0.2e0 WHEN 'FURNITURE' THEN 0.05e0 "
    "WHEN 'HOUSEHOLD' THEN -0.08e0 WHEN 'MACHINERY' THEN 0.2e0 ELSE 0.0e0 END"
)
_BASE = f"-0.1e0 + 0.9e0 * {_Z_PRICE} + -0.6e0 * {_Z_BAL} + {_STATUS} + {_REGION}"


def _linear_sql(score: str) -> dict[str, str]:
    return {"score": score, "proba": f"(1.0e0 / (1.0e0 + exp(-({score}))))", "pred": f"CAST(({score}) > 0 AS INTEGER)"}


def _case_sql(branches: list[tuple[str, int, float]], pred: int, proba: float) -> dict[str, str]:
    p = " ".join(f"WHEN {c} THEN {v}" for c, v, _ in branches)
    q = " ".join(f"WHEN {c} THEN {w}e0" for c, _, w in branches)
    return {"score": "CAST(NULL AS DOUBLE)", "pred": f"CASE {p} ELSE {pred} END", "proba": f"CASE {q} ELSE {proba}e0 END"}


_RULES_TAIL = [
    (f"{_Z_PRICE} > 0.8e0", 1, 0.85),
    (f"{_Z_BAL} <= -0.5e0 AND o_orderstatus = 'O'", 1, 0.7),
]
SQL_MODELS: dict[str, dict[str, dict[str, str]]] = {
    "oa": {
        "logreg": _linear_sql(f"{_BASE} + {_SEGMENT}"),
        "logreg_equal": _linear_sql(f"{_BASE} + 0.1e0"),
        "logreg_categorical": _linear_sql(
            "-0.3e0 + CASE o_orderstatus WHEN 'F' THEN 0.5e0 WHEN 'O' THEN -0.5e0 WHEN 'P' THEN 0.05e0 ELSE 0.0e0 END"
            " + CASE r_name WHEN 'AFRICA' THEN 0.25e0 WHEN 'AMERICA' THEN -0.25e0 WHEN 'ASIA' THEN 0.75e0"
            f" ELSE 0.0e0 END + {_SEGMENT}"
        ),
        "rulelist": _case_sql(
            [
                (f"{{g}} = 'BUILDING' AND {_Z_PRICE} > 0.2e0", 0, 0.3),
                *_RULES_TAIL,
                (f"{{g}} = 'MACHINERY' AND {_Z_BAL} > 1.0e0", 1, 0.6),
            ],
            0,
            0.0,
        ),
        "tree": _case_sql(
            [
                (f"{_Z_PRICE} <= 0.1e0 AND {{g}} <> 'HOUSEHOLD'", 0, 0.25),
                (f"{_Z_PRICE} <= 0.1e0 AND {_Z_BAL} <= 0.0e0", 1, 0.8),
                (f"{_Z_PRICE} <= 0.1e0", 0, 0.5),
                ("r_name <> 'ASIA'", 1, 0.8),
                ("{g} <> 'AUTOMOBILE'", 0, 5 / 30),
            ],
            1,
            25 / 30,
        ),
    },
}
SQL_BLIND = {
    "oa": {
        "logreg": _linear_sql(_BASE),
        "rulelist": _case_sql(_RULES_TAIL, 0, 0.0),
        "tree": _case_sql(
            [(f"{_Z_PRICE} <= 0.1e0", 0, 20 / 60), ("r_name <> 'ASIA'", 1, 0.8)], 0, 5 / 30
        ),
    },
}

# ---- documents ---------------------------------------------------------------------------------
SOURCES = tuple(sorted(f"src{i}" for i in range(20)))
DOCS_ENCODER = Encoder(
    (NumericFeature("n_chars", None, 2500.0, 3000.0),),
    (CategoricalBlock("source", SOURCES), CategoricalBlock("lang", LANGS)),
)
DOCS_LOGREG = LinearScorer(
    "logreg",
    DOCS_ENCODER,
    {
        "n_chars": 0.5, "source=src2": -0.4, "source=src10": -0.3, "source=src19": -0.3, "source=src16": 0.4,
        "lang=de": 0.1, "lang=en": -0.2, "lang=es": 0.3, "lang=fr": -0.1,
    },
    0.15,
)
DOCS_RULES = RuleListScorer(
    "rulelist",
    DOCS_ENCODER,
    (
        Rule((("n_chars", "<=", -0.6), ("lang=en", ">", 0.5)), 0, 0.35),
        Rule((("source=src2", ">", 0.5),), 0, 0.4),
        Rule((("n_chars", ">", -0.7),), 1, 0.9),
    ),
    default=1,
)
DOCS_TREE = TreeScorer(
    "tree",
    DOCS_ENCODER,
    (
        Node(0, "n_chars", -0.5, 1, 2),
        Node(1, "lang=fr", 0.5, 3, 4),
        Node(2, n0=10, n1=90),
        Node(3, n0=30, n1=20),
        Node(4, n0=4, n1=12),
    ),
)
DOCS_MODELS = [DOCS_TREE, DOCS_LOGREG, DOCS_RULES]
_Z_CHARS = "((n_chars - 2500.0e0) / 3000.0e0)"
SQL_MODELS["da"] = {
    "logreg": _linear_sql(
        f"0.15e0 + 0.5e0 * {_Z_CHARS}"
        " + CASE source WHEN 'src2' THEN -0.4e0 WHEN 'src10' THEN -0.3e0 WHEN 'src19' THEN -0.3e0"
        " WHEN 'src16' THEN 0.4e0 ELSE 0.0e0 END"
        " + CASE {g} WHEN 'de' THEN 0.1e0 WHEN 'en' THEN -0.2e0 WHEN 'es' THEN 0.3e0 WHEN 'fr' THEN -0.1e0 ELSE 0.0e0 END"
    ),
    "rulelist": _case_sql(
        [
            (f"{_Z_CHARS} <= -0.6e0 AND {{g}} = 'en'", 0, 0.35),
            ("source = 'src2'", 0, 0.4),
            (f"{_Z_CHARS} > -0.7e0", 1, 0.9),
        ],
        1,
        1.0,
    ),
    "tree": _case_sql(
        [(f"{_Z_CHARS} > -0.5e0", 1, 0.9), ("{g} <> 'fr'", 0, 0.4)], 1, 0.75
    ),
}

# ---- lineitem ----------------------------------------------------------------------------------
LINEITEM_ENCODER = Encoder(
    (
        NumericFeature("l_quantity", None, 25.0, 15.0),
        NumericFeature("l_extendedprice", None, 50000.0, 30000.0),
        NumericFeature("l_tax", None, 0.04, 0.025),
    ),
    (CategoricalBlock("l_returnflag", ("A", "N", "R")), CategoricalBlock("l_linestatus", ("F", "O"))),
)
LINEITEM_LOGREG = LinearScorer(
    "logreg",
    LINEITEM_ENCODER,
    {
        "l_quantity": 0.4, "l_extendedprice": -0.3, "l_tax": 0.5,
        "l_returnflag=A": 0.2, "l_returnflag=R": -0.2, "l_linestatus=F": 0.15, "l_linestatus=O": -0.15,
    },
    0.05,
)
LINEITEM_RULES = RuleListScorer(
    "rulelist",
    LINEITEM_ENCODER,
    (
        Rule((("l_tax", ">", 1.0),), 1, 0.8),
        Rule((("l_linestatus=F", ">", 0.5), ("l_quantity", "<=", -1.0)), 1, 0.6),
        Rule((("l_returnflag=R", ">", 0.5),), 0, 0.2),
    ),
    default=1,
)
LINEITEM_TREE = TreeScorer(
    "tree",
    LINEITEM_ENCODER,
    (
        Node(0, "l_extendedprice", 0.5, 1, 2),
        Node(1, "l_tax", 0.2, 3, 4),
        Node(2, n0=20, n1=60),
        Node(3, n0=60, n1=20),
        Node(4, "l_linestatus=O", 0.5, 5, 6),
        Node(5, n0=10, n1=30),
        Node(6, n0=30, n1=10),
    ),
)
LINEITEM_BLIND = LinearScorer(
    "logreg",
    LINEITEM_ENCODER.without("l_linestatus"),
    {"l_quantity": 0.4, "l_extendedprice": -0.3, "l_tax": 0.5, "l_returnflag=A": 0.2, "l_returnflag=R": -0.2},
    0.05,
    include_sensitive=False,
)
LINEITEM_MODELS = [LINEITEM_TREE, LINEITEM_LOGREG, LINEITEM_RULES]
_Z_QTY, _Z_EXT, _Z_TAX = (
    "((l_quantity - 25.0e0) / 15.0e0)", "((l_extendedprice - 50000.0e0) / 30000.0e0)", "((l_tax - 0.04e0) / 0.025e0)",
)
_LINE_BASE = (
    f"0.05e0 + 0.4e0 * {_Z_QTY} + -0.3e0 * {_Z_EXT} + 0.5e0 * {_Z_TAX}"
    " + CASE l_returnflag WHEN 'A' THEN 0.2e0 WHEN 'R' THEN -0.2e0 ELSE 0.0e0 END"
)
SQL_MODELS["la"] = {
    "logreg": _linear_sql(f"{_LINE_BASE} + CASE {{g}} WHEN 'F' THEN 0.15e0 WHEN 'O' THEN -0.15e0 ELSE 0.0e0 END"),
    "rulelist": _case_sql(
        [(f"{_Z_TAX} > 1.0e0", 1, 0.8), (f"{{g}} = 'F' AND {_Z_QTY} <= -1.0e0", 1, 0.6), ("l_returnflag = 'R'", 0, 0.2)],
        1,
        1.0,
    ),
    "tree": _case_sql(
        [(f"{_Z_EXT} > 0.5e0", 1, 0.75), (f"{_Z_TAX} <= 0.2e0", 0, 0.25), ("{g} <> 'O'", 1, 0.75)], 0, 0.25
    ),
}
SQL_BLIND["la"] = {"logreg": _linear_sql(_LINE_BASE)}
