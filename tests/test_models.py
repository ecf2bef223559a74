from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand import AuditFrame
from evenhand.operators import agreement, fitting
from evenhand.operators import scorers as S
from evenhand.operators.features import CategoricalBlock, Encoder, NumericFeature
from evenhand.operators.scorers import ExpressionScorer, LinearScorer, Node, Rule, RuleListScorer, Scored, TreeScorer

ENCODER = Encoder((NumericFeature("n"),), (CategoricalBlock("s", ("a", "b")),))


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(0, -1.0, "a"), (1, 0.0, "b"), (2, 2.0, None)], "id int, n double, s string")


def _preds(df, scorer):
    out = scorer()
    return [tuple(r) for r in df.orderBy("id").select(out.pred, F.round(out.proba, 9)).collect()]


def test_score_zero_is_class_zero(rows):
    assert [p for p, _ in _preds(rows, LinearScorer("m", ENCODER, {"n": 1.0}))] == [0, 0, 1]
    assert _preds(rows, LinearScorer("m", ENCODER, {"n": 1.0}))[1][1] == 0.5


def test_rule_lists(rows):
    always = RuleListScorer("m", ENCODER, (Rule((), 1, 0.6),), default=0)
    assert _preds(rows, always) == [(1, 0.6)] * 3
    assert _preds(rows, RuleListScorer("m", ENCODER, (), default=1)) == [(1, 1.0)] * 3
    first = RuleListScorer("m", ENCODER, (Rule((("n", ">", 0.0),), 0, 0.2), Rule((("n", ">", -5.0),), 1, 0.9)), 0)
    assert _preds(rows, first) == [(1, 0.9), (1, 0.9), (0, 0.2)]


def test_tree_ties_and_paths(rows):
    tree = TreeScorer("m", ENCODER, (Node(0, "s=a", 0.5, 1, 2), Node(1, n0=2, n1=2), Node(2, n0=1, n1=3)))
    assert _preds(rows, tree) == [(1, 0.75), (0, 0.5), (0, 0.5)]
    assert tree.rules() == (Rule((("s=a", "<=", 0.5),), 0, 0.5), Rule((("s=a", ">", 0.5),), 1, 0.75))
    single = TreeScorer("m", ENCODER, (Node(0, n0=1, n1=4),))
    assert single.rules() == (Rule((), 1, 0.8),) and _preds(rows, single) == [(1, 0.8)] * 3


def test_rule_table_equals_chain(spark, rows):
    scorer = RuleListScorer(
        "m", ENCODER, (Rule((("s=a", ">", 0.5), ("n", "<=", -1.0)), 1, 0.7), Rule((("n", ">", 1.0),), 1, 0.8)), 0
    )
    values = F.create_map(*[x for n, c in ENCODER.columns().items() for x in (F.lit(n), c)])
    table = S.score_rule_table(
        rows.select("id", values.alias("values"), F.lit("m").alias("model")), S.rule_table(spark, [scorer]), ["id"]
    )
    got = [(r["pred"], r["proba"]) for r in table.orderBy("id").collect()]
    assert got == _preds(rows, scorer)


def test_own_expression_and_names(rows):
    own = ExpressionScorer("own", lambda c: Scored(S.NO_SCORE, "0.5D", f"CAST({c('n')} >= 0 AS INT)"))
    assert [p for p, _ in _preds(rows, own)] == [0, 1, 1]
    assert S.make_scorer("logreg", "m", ENCODER, {"n": 1.0}) == LinearScorer("m", ENCODER, {"n": 1.0})
    with pytest.raises(ValueError):
        S.make_scorer("forest", "m")


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, z = rng.normal(size=n), rng.normal(size=n)
    s = rng.choice(["a", "b", "c"], size=n)
    p = 1 / (1 + np.exp(-(0.8 * x - 0.5 * z + np.where(s == "a", 0.7, -0.2))))
    y = (rng.random(n) < p).astype(int)
    data = [(i, float(x[i]), float(z[i]), str(s[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "id int, x double, z double, s string, y int")
    return AuditFrame(df, "y", "s", ("x", "z"), ("s",), row_id="id")


def test_logreg_equals_newton(training):
    fitted = fitting.fit("logreg", training)
    rows = fitted.encoder.transform(training.df, ["id", "y"]).orderBy("id").toPandas()
    names = fitted.encoder.names()
    a = np.c_[rows[names].to_numpy(float), np.ones(len(rows))]
    y = rows["y"].to_numpy(float)
    penalty = np.diag([1.0] * len(names) + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    got = [fitted.scorer.weights[n] for n in names] + [fitted.scorer.intercept]
    assert np.allclose(got, w, atol=1e-5)


def test_fitted_models_agree_with_their_expressions(training):
    for fitted in fitting.fit_all(training):
        row = agreement.check_fitted(fitted, training.df, "id", "d", None).first()
        assert (row["samples_checked"], row["mismatch_count"], row["match_rate"]) == (400, 0, 100.0)
    few = agreement.check_fitted(fitting.fit("tree", training), training.df, "id", "d", 10).first()
    assert few["samples_checked"] == 10
    with pytest.raises(ValueError):
        fitting.fit("forest", training)


def test_blind_fit_has_no_group_feature(training):
    fitted = fitting.fit("logreg", training, include_sensitive=False)
    assert fitted.encoder.names() == ["x", "z"] and not fitted.scorer.include_sensitive


def test_match_rate_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, l int, r int")
    assert agreement.agreement(empty, "l", "r", "d", "m").first()["match_rate"] == 0.0
    both = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(30)], "id int, l int, r int")
    row = agreement.agreement(both, "l", "r", "d", "m").first()
    assert row["mismatch_count"] == 10 and row["match_rate"] == pytest.approx(66.67)
    assert [r["row_id"] for r in agreement.mismatches(both, "id", "l", "r", 3).collect()] == [0, 3, 6]
    assert math.isclose(row["match_rate"], 66.67)
