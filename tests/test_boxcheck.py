"""Box checks against enumeration on random small models."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evenhand import AuditFrame
from evenhand.operators import boxcheck
from evenhand.operators import scorers as S
from evenhand.operators.features import CategoricalBlock, Encoder, NumericFeature
from evenhand.operators.scorers import LinearScorer, Node, Rule, RuleListScorer, TreeScorer
from evenhand.plans import audit
from evenhand.session import settle

GROUPS = ("g1", "g2", "g3")
BLOCKS = (CategoricalBlock("c", ("u", "v", "w")), CategoricalBlock("d", ("p", "q")))
ENCODER = Encoder(
    (NumericFeature("x", None, 1.0, 2.0), NumericFeature("y")), (*BLOCKS, CategoricalBlock("s", GROUPS))
)
CATEGORICAL = Encoder((), ENCODER.blocks)
X_BOX, Y_BOX = (-1.0, 1.0), (0.0, 2.0)


def _bounds(spark, rows=(("x", *X_BOX), ("y", *Y_BOX))):
    return spark.createDataFrame(list(rows), "feature string, lo double, hi double")


def _statuses(pairs):
    return {(r["model"], r["source_group"], r["target_group"]): r["status"] for r in pairs.collect()}


def _linear_truth(model, with_numeric):
    def w(name):
        return model.weights.get(name, 0.0)

    out = {}
    for a, b in itertools.permutations(GROUPS, 2):
        lo_w, hi_w = -max(w(f"s={a}"), w(f"s={b}")), -min(w(f"s={a}"), w(f"s={b}"))
        sat = False
        for c, d in itertools.product(BLOCKS[0].categories, BLOCKS[1].categories):
            lo = hi = model.intercept
            if with_numeric:
                for f, (m, n) in (("x", X_BOX), ("y", Y_BOX)):
                    lo += min(w(f) * m, w(f) * n)
                    hi += max(w(f) * m, w(f) * n)
            shift_c, shift_d = w(f"c={c}"), w(f"d={d}")
            lo, hi = lo + shift_c + shift_d, hi + shift_c + shift_d
            sat |= lo_w < hi_w and hi > lo_w and lo <= hi_w
        out[model.name, a, b] = "sat" if sat else "unsat"
    return out


@pytest.mark.parametrize(("with_numeric", "lazy"), [(True, 3), (False, 3), (True, 0)])
def test_linear_models_against_enumeration(spark, monkeypatch, with_numeric, lazy):
    monkeypatch.setattr(boxcheck, "LAZY_COLUMNS", lazy)
    rng = random.Random(11)
    encoder = ENCODER if with_numeric else CATEGORICAL
    grid = [i / 8 for i in range(-12, 13)]  # exact in binary, so end points are hit exactly
    models = []
    for i in range(60):
        weights = {n: rng.choice(grid) for n in encoder.names()}
        for n in ("x", "y"):
            if n in weights:
                weights[n] /= 16  # narrow numeric ranges leave gaps between the intervals
        models.append(LinearScorer(f"m{i:02d}", encoder, weights, rng.choice(grid)))
    schema = encoder.schema_table(spark)
    terms = boxcheck.linear_terms(S.weight_table(spark, models), schema, _bounds(spark))
    stages = boxcheck.fold_intervals(terms, boxcheck.categorical_columns(schema, "s"), "s")
    pairs = settle(boxcheck.linear_box_pairs(terms, schema, "s", stages))
    expected = {k: v for m in models for k, v in _linear_truth(m, with_numeric).items()}
    assert _statuses(pairs) == expected
    assert set(expected.values()) == {"sat", "unsat"}
    # every witness lies in the box and changes its prediction with the group
    witnesses = boxcheck.linear_witness(terms, schema, "s", pairs, stages).collect()
    by_name = {m.name: m for m in models}
    assert {w["model"] for w in witnesses} == {k[0] for k, v in expected.items() if v == "sat"}
    margin = {(r["model"], r["source_group"], r["target_group"]): r["margin"] for r in pairs.collect()}
    rows = []
    for w in witnesses:
        x = w["example_x"]
        assert {k for k in x if x[k] != w["example_y"][k]} == {"s"}
        for f, (lo, hi), mean, scale in (("x", X_BOX, 1.0, 2.0), ("y", Y_BOX, 0.0, 1.0)):
            if with_numeric:
                assert lo - 1e-9 <= (float(x[f]) - mean) / scale <= hi + 1e-9
        rows.append((w["model"], float(x.get("x", 0)), float(x.get("y", 0)), x["c"], x["d"], x["s"], w["example_y"]["s"]))
    table = spark.createDataFrame(rows, "model string, x double, y double, c string, d string, s string, t string")
    for r in table.collect():
        m = by_name[r["model"]]
        one = table.filter(F.col("model") == r["model"])
        p = one.select(m().pred).first()[0]
        q = one.select(m(lambda n: "t" if n == "s" else n).pred).first()[0]
        knife_edge = margin[r["model"], r["s"], r["t"]] < 1e-9
        assert p != q or knife_edge


def test_undecidable_and_equal_weights(spark):
    equal = LinearScorer("equal", ENCODER, {"x": 1.0, **{f"s={g}": 0.5 for g in GROUPS}})
    schema = ENCODER.schema_table(spark)
    weights = S.weight_table(spark, [equal, LinearScorer("gap", ENCODER, {"x": 1.0, "s=g1": 0.5})])
    broken = weights.withColumn("weight", F.when((F.col("model") == "gap") & (F.col("feature") == "x"), None).otherwise(F.col("weight")))
    got = _statuses(boxcheck.linear_box_pairs(boxcheck.linear_terms(broken, schema, _bounds(spark)), schema, "s"))
    assert {v for k, v in got.items() if k[0] == "equal"} == {"unsat"}
    assert {v for k, v in got.items() if k[0] == "gap"} == {"unknown"}
    # a missing bound is undecidable too
    half = _bounds(spark, [("x", *X_BOX)])
    got = _statuses(boxcheck.linear_box_pairs(boxcheck.linear_terms(weights, schema, half), schema, "s"))
    assert set(got.values()) == {"unknown"}


def test_score_zero_window_ends(spark):
    """The window is open below and closed above, because class 1 needs a score above zero."""
    cases = {"at_low": -0.5, "at_high": 0.0}  # base values; weights 0.5 and 0
    models = [LinearScorer(n, CATEGORICAL, {"s=g1": 0.5}, b) for n, b in cases.items()]
    schema = CATEGORICAL.schema_table(spark)
    terms = boxcheck.linear_terms(S.weight_table(spark, models), schema, _bounds(spark))
    pairs = boxcheck.linear_box_pairs(terms, schema, "s")
    got = _statuses(pairs)
    assert got["at_low", "g1", "g2"] == "unsat"  # 0 and -0.5: both class 0
    assert got["at_high", "g1", "g2"] == "sat"  # 0.5 and 0
    margin = {(r["model"], r["source_group"], r["target_group"]): r["margin"] for r in pairs.collect()}
    assert margin["at_high", "g1", "g2"] == 0.0


def _random_tree(rng, name, depth=4):
    nodes = []

    def grow(d):
        i = len(nodes)
        nodes.append(None)
        if d == 0 or rng.random() < 0.15:
            nodes[i] = Node(i, n0=rng.randint(0, 5), n1=rng.randint(0, 5))
            return i
        f = rng.choice(ENCODER.names())
        t = rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0, 1.5]) if f in ("x", "y") else rng.choice([0.5, 0.5, 0.5, 0.0, 1.0, -0.5])
        left, right = grow(d - 1), grow(d - 1)
        nodes[i] = Node(i, f, t, left, right)
        return i

    grow(depth)
    return TreeScorer(name, ENCODER, tuple(nodes))


def _random_rules(rng, name):
    rules = []
    for _ in range(rng.randint(1, 5)):
        conditions = []
        for _ in range(rng.randint(0, 3)):
            f = rng.choice(ENCODER.names())
            t = rng.choice([-0.5, 0.0, 0.5, 1.0, 1.5]) if f in ("x", "y") else 0.5
            conditions.append((f, rng.choice(["<=", ">"]), t))
        rules.append(Rule(tuple(conditions), rng.randint(0, 1), 0.5))
    return RuleListScorer(name, ENCODER, tuple(rules), rng.randint(0, 1))


def test_regions_against_a_grid(spark):
    """Trees and overlapping rule lists against every cell of a grid through all thresholds."""
    rng = random.Random(23)
    models = [_random_tree(rng, f"t{i:02d}") for i in range(14)] + [_random_rules(rng, f"r{i:02d}") for i in range(14)]
    steps = [-1.0, -0.75, -0.5, -0.25, 0.0, 0.1, 0.25, 0.3, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0]
    xs = [v for v in steps if X_BOX[0] <= v <= X_BOX[1]]
    ys = [v for v in steps if Y_BOX[0] <= v <= Y_BOX[1]]
    cells = [
        (i, 2 * x + 1, y, c, d)
        for i, (x, y, c, d) in enumerate(itertools.product(xs, ys, BLOCKS[0].categories, BLOCKS[1].categories))
    ]
    grid = spark.createDataFrame(cells, "cell int, x double, y double, c string, d string").cache()
    expected = {}
    for m in models:
        row = grid.select(*[m(lambda n, g=g: f"'{g}'" if n == "s" else n).pred.alias(g) for g in GROUPS])
        seen = row.distinct().collect()
        for a, b in itertools.permutations(GROUPS, 2):
            expected[m.name, a, b] = "sat" if any(r[a] != r[b] for r in seen) else "unsat"
    schema = settle(ENCODER.schema_table(spark))
    bounds = _bounds(spark)
    regions = boxcheck.disjoint_regions(S.rule_table(spark, models))
    pairs = settle(boxcheck.region_box_pairs(regions, schema, bounds, "s"))
    assert _statuses(pairs) == expected
    assert set(expected.values()) == {"sat", "unsat"}
    by_name = {m.name: m for m in models}
    witnesses = boxcheck.region_witness(regions, schema, bounds, "s", pairs).collect()
    assert {w["model"] for w in witnesses} == {k[0] for k, v in expected.items() if v == "sat"}
    for w in witnesses:
        x = w["example_x"]
        one = spark.createDataFrame(
            [(float(x["x"]), float(x["y"]), x["c"], x["d"], x["s"], w["example_y"]["s"])],
            "x double, y double, c string, d string, s string, t string",
        )
        m = by_name[w["model"]]
        got = one.select(m().pred.alias("p"), m(lambda n: "t" if n == "s" else n).pred.alias("q")).first()
        assert (got["p"], got["q"]) == (w["prediction_x"], w["prediction_y"]) and got["p"] != got["q"]


def test_missing_bound_is_unknown(spark):
    tree = TreeScorer(
        "t", ENCODER, (Node(0, "x", 0.0, 1, 2), Node(1, n0=1), Node(2, "s=g1", 0.5, 3, 4), Node(3, n0=1), Node(4, n1=1))
    )
    regions = boxcheck.disjoint_regions(S.rule_table(spark, [tree]))
    schema = ENCODER.schema_table(spark)
    known = _statuses(boxcheck.region_box_pairs(regions, schema, _bounds(spark), "s"))
    assert known["t", "g1", "g2"] == "sat" and known["t", "g2", "g3"] == "unsat"
    narrow = _bounds(spark, [("x", -1.0, 0.0), ("y", *Y_BOX)])
    assert set(_statuses(boxcheck.region_box_pairs(regions, schema, narrow, "s")).values()) == {"unsat"}
    open_ = _statuses(boxcheck.region_box_pairs(regions, schema, _bounds(spark, [("y", *Y_BOX)]), "s"))
    assert open_["t", "g1", "g2"] == "unknown"


def test_observed_violations_lie_in_the_box(spark):
    rng = random.Random(2)
    rows = [
        (i, rng.uniform(-1, 3), rng.uniform(0, 2), rng.choice("uvw"), rng.choice("pq"), rng.choice(GROUPS), rng.randint(0, 1))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id int, x double, y double, c string, d string, s string, label int")
    f = AuditFrame(df, "label", "s", ("x", "y"), ("c", "d", "s"), row_id="id")
    models = [
        LinearScorer("logreg", ENCODER, {"x": 0.5, "y": -0.4, "c=u": 0.3, "s=g1": 0.2, "s=g3": -0.3}, 0.1),
        _random_tree(rng, "tree"),
        _random_rules(rng, "rulelist"),
    ]
    box = {r["model"]: r for r in audit.box_documents(f, models, "d").collect()}
    seen = {r["model"]: r for r in audit.observed_documents(f, models, "d").collect()}
    for name, doc in seen.items():
        wide = {(p["source_group"], p["target_group"]): p["status"] for p in box[name]["pair_checks"]}
        for p in doc["pair_checks"]:
            assert p["status"] != "sat" or wide[p["source_group"], p["target_group"]] == "sat"
    assert box["logreg"]["overall_status"] == "SAT" and box["logreg"]["first_counterexample"]["score_x"] is not None


def test_no_model_is_without_a_document(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(-1, 3), rng.choice("uvw"), i % 2, rng.randint(0, 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, c string, s int, label int")
    f = AuditFrame(df, "label", "s", ("x", "s"), ("c",), row_id="id")
    blind = Encoder((NumericFeature("x"),), (CategoricalBlock("c", ("u", "v", "w")),))
    number = Encoder((NumericFeature("x"), NumericFeature("s")), ())
    models = [LinearScorer("blind", blind, {"x": 0.5}, 0.1), LinearScorer("number", number, {"x": 0.5, "s": 0.3}, 0.1)]
    docs = {r["model"]: r for r in audit.box_documents(f, models, "d").collect()}
    assert docs["blind"]["overall_status"] == "UNSAT" and len(docs["blind"]["pair_checks"]) == 2
    # a group that a model sees as a number is checked at its value
    assert docs["number"]["overall_status"] == "SAT"
    assert docs["number"]["first_counterexample"]["example_x"]["s"] == docs["number"]["first_counterexample"]["source_group"]


VALUES = (0.0, 1.0, 3.0)  # of a sensitive column that models see as a number
NUMERIC = Encoder(
    (NumericFeature("x", None, 1.0, 2.0), NumericFeature("s", None, 0.5, 2.0)), (CategoricalBlock("c", ("u", "v", "w")),)
)


def _numeric_frame(spark, xs):
    rows = [(i, x, c, s, 0) for i, (x, c, s) in enumerate(itertools.product(xs, "uvw", VALUES))]
    df = spark.createDataFrame(rows, "id int, x double, c string, s double, y int")
    return AuditFrame(df, "y", "s", ("x", "s"), ("c",), row_id="id")


def _document_statuses(docs):
    return {(d["model"], p["source_group"], p["target_group"]): p["status"] for d in docs.collect() for p in d["pair_checks"]}


def test_numeric_sensitive_linear_equals_one_hot(spark):
    rng = random.Random(21)
    grid = [0.0, 0.25, -0.25, 0.5, 3.0]
    frame = _numeric_frame(spark, (-1.0, 3.0))
    groups = tuple(str(v) for v in VALUES)
    one_hot = Encoder((NUMERIC.numeric[0],), (*NUMERIC.blocks, CategoricalBlock("s", groups)))
    numeric, listed = [], []
    for i in range(14):
        shared = {n: rng.choice(grid) for n in ("x", "c=u", "c=v", "c=w")}
        w = rng.choice([0.0, 0.25, -0.5, 1.0])
        numeric.append(LinearScorer(f"m{i}", NUMERIC, {**shared, "s": w}, rng.choice([-4.0, 0.0, 0.5, 9.0])))
        fixed = {f"s={g}": w * ((v - 0.5) / 2.0) for g, v in zip(groups, VALUES)}
        listed.append(LinearScorer(f"m{i}", one_hot, {**shared, **fixed}, numeric[-1].intercept))
    docs = audit.box_documents(frame, numeric, "d")
    got = _document_statuses(docs)
    assert got == _document_statuses(audit.box_documents(frame, listed, "d"))
    assert set(got.values()) == {"sat", "unsat"} and len(got) == 14 * 6
    for d in docs.collect():  # the witness is an input of the box that shows the violation
        if d["overall_status"] == "SAT":
            first, model = d["first_counterexample"], next(m for m in numeric if m.name == d["model"])
            assert first["prediction_x"] != first["prediction_y"]
            for side in ("x", "y"):
                e = first[f"example_{side}"]
                score = model.intercept + model.weights["x"] * (float(e["x"]) - 1.0) / 2.0 + model.weights[f"c={e['c']}"]
                score += model.weights["s"] * (float(e["s"]) - 0.5) / 2.0
                assert int(score > 1e-9) == first[f"prediction_{side}"] or abs(score) < 1e-6


def test_numeric_sensitive_regions_equal_enumeration(spark):
    rng = random.Random(22)
    cuts = [-0.75, -0.25, 0.0, 0.25, 0.75, 1.25]
    xs = [1.0 + 2.0 * z for z in (-1.0, 1.0, *(t + e for t in cuts[:5] for e in (0.0, 0.01)))]
    frame = _numeric_frame(spark, sorted(xs))
    scorers = []
    for i in range(10):
        rules = tuple(
            Rule(tuple((f, rng.choice(["<=", ">"]), 0.5 if "=" in f else rng.choice(cuts)) for f in rng.sample(["x", "s", "s", "c=u"], 2)), rng.randrange(2), 0.5)
            for _ in range(3)
        )
        scorers.append(RuleListScorer(f"r{i}", NUMERIC, rules, rng.randrange(2)))
    got = _document_statuses(audit.box_documents(frame, scorers, "d"))
    observed = _document_statuses(audit.observed_documents(frame, scorers, "d"))
    assert got == observed and set(got.values()) == {"sat", "unsat"}
