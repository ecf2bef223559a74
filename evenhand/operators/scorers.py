"""Models as generated column expressions.

A scorer is a function from a column lookup to score, probability and prediction. A counterfactual
is the same function with one column of the lookup replaced, so both sides share one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.expressions import Lookup, literal, number, plain
from evenhand.operators.features import DictionaryBlock, Encoder

NO_SCORE = "CAST(NULL AS DOUBLE)"
JOINT_MODELS = 6


@dataclass(frozen=True)
class Scored:
    """Expression texts of one model for one lookup, and the same as columns."""

    score_text: str
    proba_text: str
    pred_text: str

    @property
    def score(self) -> Column:
        return F.expr(self.score_text)

    @property
    def proba(self) -> Column:
        return F.expr(self.proba_text)

    @property
    def pred(self) -> Column:
        return F.expr(self.pred_text)


@dataclass(frozen=True)
class LinearScorer:
    """``score = intercept + Σ weight·feature``; class 1 iff the score is strictly positive.

    The weights of a dictionary column are a table ``(value, weight)`` in ``tables``; a row needs them joined
    (:func:`with_tables`) before it is scored.
    """

    name: str
    encoder: Encoder
    weights: dict[str, float]
    intercept: float = 0.0
    include_sensitive: bool = True
    kind: str = "logreg"
    tables: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def __call__(self, lookup: Lookup = plain) -> Scored:
        terms = [number(self.intercept)]
        for f in self.encoder.numeric:
            w = float(self.weights.get(f.name, 0.0))
            if w != 0.0:
                terms.append(f"{number(w)} * {f.text(lookup)}")
        terms += [t for b in self.encoder.blocks if (t := self._block_term(b, lookup))]
        score = f"({' + '.join(terms)})"
        return Scored(score, f"(1D / (1D + exp(-{score})))", f"CAST({score} > 0D AS INT)")

    def _block_term(self, block, lookup: Lookup) -> str | None:
        """One lookup per categorical column instead of one product per category."""
        if isinstance(block, DictionaryBlock):
            if lookup(block.source) != plain(block.source):
                raise ValueError(f"{block.source} is a dictionary column and cannot be changed in place")
            return f"coalesce({plain(self.weight_column(block.source))}, 0D)" if block.source in self.tables else None
        weighted = [(c, float(self.weights.get(n, 0.0))) for c, n in zip(block.categories, block.names())]
        weighted = [(c, w) for c, w in weighted if w != 0.0]
        if not weighted:
            return None
        branches = " ".join(f"WHEN {literal(c)} THEN {number(w)}" for c, w in weighted)
        return f"CASE {block.value(lookup)} {branches} ELSE 0D END"

    def weight_column(self, source: str) -> str:
        return f"_weight_{self.name}_{'seen' if self.include_sensitive else 'blind'}_{source}"

    def weight_rows(self) -> list[tuple]:
        """``(model, feature, weight)`` with the intercept as a row of its own, without dictionary columns."""
        return [(self.name, "(intercept)", float(self.intercept))] + [
            (self.name, n, float(self.weights.get(n, 0.0))) for n in self.encoder.inline().names()
        ]


@dataclass(frozen=True)
class Rule:
    conditions: tuple[tuple[str, str, float], ...]  # (feature, "<=" or ">", threshold)
    pred: int
    proba: float


@dataclass(frozen=True)
class RuleListScorer:
    """First matching rule wins; without a match the default class, with probability 0 or 1."""

    name: str
    encoder: Encoder
    rules: tuple[Rule, ...]
    default: int = 0
    include_sensitive: bool = True
    kind: str = "rulelist"

    def __call__(self, lookup: Lookup = plain) -> Scored:
        default, default_proba = str(int(self.default)), "1D" if self.default == 1 else "0D"
        hits = [all_of(self.encoder, r.conditions, lookup) for r in self.rules]
        pred = " ".join(f"WHEN {h} THEN {int(r.pred)}" for h, r in zip(hits, self.rules))
        proba = " ".join(f"WHEN {h} THEN {number(r.proba)}" for h, r in zip(hits, self.rules))
        if not self.rules:
            return Scored(NO_SCORE, default_proba, default)
        return Scored(NO_SCORE, f"CASE {proba} ELSE {default_proba} END", f"CASE {pred} ELSE {default} END")

    def rule_rows(self) -> list[tuple]:
        """``(model, rule_no, conds, pred, proba)``; the default is the last, condition-free rule."""
        rows = [(self.name, i, list(r.conditions), int(r.pred), float(r.proba)) for i, r in enumerate(self.rules)]
        return rows + [(self.name, len(self.rules), [], int(self.default), 1.0 if self.default == 1 else 0.0)]


def all_of(encoder: Encoder, conditions, lookup: Lookup = plain) -> str:
    """Conjunction of threshold conditions; no condition at all is TRUE."""
    return " AND ".join(encoder.condition(f, op, t, lookup) for f, op, t in conditions) or "TRUE"


@dataclass(frozen=True)
class Node:
    id: int
    feature: str | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    n0: float = 0.0
    n1: float = 0.0

    @property
    def leaf(self) -> bool:
        return self.left is None

    @property
    def pred(self) -> int:
        return 1 if self.n1 > self.n0 else 0

    @property
    def proba(self) -> float:
        total = self.n0 + self.n1
        return self.n1 / total if total > 0 else float(self.pred)


@dataclass(frozen=True)
class TreeScorer:
    """Node table walked as nested conditions; ``<=`` goes left, an equal count is class 0."""

    name: str
    encoder: Encoder
    nodes: tuple[Node, ...]
    include_sensitive: bool = True
    kind: str = "tree"
    _by_id: dict = field(default_factory=dict, compare=False, repr=False)

    def __call__(self, lookup: Lookup = plain) -> Scored:
        pred = self._walk(self.root(), lookup, lambda n: str(n.pred))
        proba = self._walk(self.root(), lookup, lambda n: number(n.proba))
        return Scored(NO_SCORE, proba, pred)

    def root(self) -> Node:
        return self.nodes[0]

    def node(self, node_id: int) -> Node:
        if not self._by_id:
            self._by_id.update({n.id: n for n in self.nodes})
        return self._by_id[node_id]

    def _walk(self, node: Node, lookup: Lookup, value) -> str:
        if node.leaf:
            return value(node)
        below = self.encoder.condition(node.feature, "<=", node.threshold, lookup)
        left = self._walk(self.node(node.left), lookup, value)
        right = self._walk(self.node(node.right), lookup, value)
        return f"CASE WHEN {below} THEN {left} ELSE {right} END"

    def rules(self) -> tuple[Rule, ...]:
        """Every root-to-leaf path as a rule, left branches first."""
        out: list[Rule] = []
        stack: list[tuple[Node, tuple]] = [(self.root(), ())]
        while stack:
            node, conditions = stack.pop()
            if node.leaf:
                out.append(Rule(conditions, node.pred, node.proba))
                continue
            stack.append((self.node(node.right), (*conditions, (node.feature, ">", float(node.threshold)))))
            stack.append((self.node(node.left), (*conditions, (node.feature, "<=", float(node.threshold)))))
        return tuple(out)

    def rule_rows(self) -> list[tuple]:
        return [(self.name, i, list(r.conditions), r.pred, r.proba) for i, r in enumerate(self.rules())]


@dataclass(frozen=True)
class ExpressionScorer:
    """Your own model: a function from the column lookup to :class:`Scored`.

    ``ExpressionScorer("rich", lambda c: Scored("NULL", "0.5D", f"CAST({c('income')} > 9000 AS INT)"))``
    """

    name: str
    build: Callable[[Lookup], Scored]
    include_sensitive: bool = True
    kind: str = "expression"

    def __call__(self, lookup: Lookup = plain) -> Scored:
        return self.build(lookup)


SCORERS = {"logreg": LinearScorer, "tree": TreeScorer, "rulelist": RuleListScorer, "expression": ExpressionScorer}


def make_scorer(kind: str, *args, **kwargs):
    """Scorer by model name; an unknown name is an error."""
    if kind not in SCORERS:
        raise ValueError(f"model must be one of {sorted(SCORERS)}, not {kind!r}")
    return SCORERS[kind](*args, **kwargs)


def rule_list_from_tree(tree: TreeScorer, default: int, name: str | None = None) -> RuleListScorer:
    return RuleListScorer(name or tree.name, tree.encoder, tree.rules(), default, tree.include_sensitive)


def with_tables(df: DataFrame, scorers: list) -> DataFrame:
    """The rows with the weights of their dictionary columns; rows that have them already stay as they are."""
    for s in scorers:
        for b in s.encoder.dictionaries if getattr(s, "tables", None) else []:
            if b.source in s.tables and s.weight_column(b.source) not in df.columns:
                df = b.joined(df, s.tables[b.source], "weight", s.weight_column(b.source))
    return df


def table_columns(scorers: list) -> list[str]:
    """What :func:`with_tables` adds."""
    return list(dict.fromkeys(s.weight_column(c) for s in scorers for c in getattr(s, "tables", {})))


def score_models(df: DataFrame, scorers: list, keep: list[str]) -> DataFrame:
    """All models over one scan: one output row per (row, model)."""
    df = with_tables(df, scorers)
    parts = []
    for s in scorers:
        out = s()
        parts.append(
            f"named_struct('model', {literal(s.name)}, 'include_sensitive', {str(s.include_sensitive).lower()}, "
            f"'score', {out.score_text}, 'proba', {out.proba_text}, 'pred', {out.pred_text})"
        )
    return df.select(*keep, F.expr(f"inline(array({', '.join(parts)}))"))


def of_model(scorers: list, value: Callable[[object], str]) -> Column:
    """For rows that carry ``model``: the value of that row's model."""
    branches = " ".join(f"WHEN {literal(s.name)} THEN {value(s)}" for s in scorers)
    return F.expr(f"CASE model {branches} END")


def count_models(df: DataFrame, keep: list[str], values: list[tuple], first: str | None = None) -> DataFrame:
    """Rows per (kept columns, model, values): ``values`` pairs each scorer with named expression texts.

    With few models one aggregate keyed by the values of all of them is enough: a row is hashed once
    however many models there are, and the short result is turned into one line per model
    afterwards. The joint keys multiply with every model, so longer lists get a line per model
    before the aggregate. ``first`` adds the smallest value of a column, such as a row id.
    """
    scorers = [s for s, _ in values]
    df = with_tables(df, scorers)
    names = list(values[0][1])
    firsts = [F.min(first).alias("first_row")] if first else []
    carried = [first] if first else []

    def lines(text: Callable[[int, str], str]) -> Column:
        structs = []
        for i, s in enumerate(scorers):
            fields = ", ".join(f"{literal(n)}, {text(i, n)}" for n in names)
            head = f"'model', {literal(s.name)}, 'include_sensitive', {str(s.include_sensitive).lower()}"
            structs.append(f"named_struct({head}, {fields})")
        return F.expr(f"inline(array({', '.join(structs)}))")

    if len(scorers) > JOINT_MODELS:
        rows = df.select(*keep, *carried, lines(lambda i, n: values[i][1][n]))
        return rows.groupBy(*keep, "model", "include_sensitive", *names).agg(F.count("*").alias("n"), *firsts)
    flat = {f"_{n}_{i}": texts[n] for i, (_, texts) in enumerate(values) for n in names}
    joint = (
        df.select(*keep, *carried, *[F.expr(t).alias(c) for c, t in flat.items()])
        .groupBy(*keep, *flat)
        .agg(F.count("*").alias("n"), *firsts)
    )
    kept = [*keep, "n", *(["first_row"] if first else [])]
    return joint.select(*kept, lines(lambda i, n: f"_{n}_{i}"))


def score_rule_table(rows: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """Rule lists given as a table, for many models or more rules than fit one chain of conditions.

    ``rows`` carries ``model`` and ``values map<feature,double>``; ``rules`` is
    ``(model, rule_no, conds array<struct<feature,op,threshold>>, pred, proba)``. A model's rules
    travel as one array, so each row meets its model once and picks the first match in place.
    """
    listed = rules.groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("rule_no", "conds", "pred", "proba"))).alias("rule_list")
    )
    first = F.expr(
        """get(filter(rule_list, r -> forall(r.conds, c ->
             case when c.op = '<=' then values[c.feature] <= c.threshold else values[c.feature] > c.threshold end)), 0)"""
    )
    return (
        rows.join(listed, "model")
        .withColumn("hit", first)
        .select(*keep, "model", F.col("hit.rule_no").alias("rule_no"), F.col("hit.pred").alias("pred"),
                F.col("hit.proba").alias("proba"))
    )


def rule_table(spark: SparkSession, scorers: list) -> DataFrame:
    """``rules(model, rule_no, conds, pred, proba)`` of tree and rule-list scorers."""
    rows = [r for s in scorers for r in s.rule_rows()]
    return spark.createDataFrame(
        rows,
        "model string, rule_no int, conds array<struct<feature:string,op:string,threshold:double>>, "
        "pred int, proba double",
    )


def weight_table(spark: SparkSession, scorers: list) -> DataFrame:
    """``weights(model, feature, weight)`` of linear scorers; the intercept is feature ``(intercept)``."""
    out = spark.createDataFrame([r for s in scorers for r in s.weight_rows()], "model string, feature string, weight double")
    for s in scorers:
        for source, table in s.tables.items():
            named = F.concat(F.lit(f"{source}="), F.col("value")).alias("feature")
            out = out.unionByName(table.select(F.lit(s.name).alias("model"), named, "weight"))
    return out
