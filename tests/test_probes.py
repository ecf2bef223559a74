from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evenhand import AuditFrame
from evenhand.operators import metrics, paircheck, probes
from evenhand.operators.features import CategoricalBlock, Encoder, NumericFeature
from evenhand.operators.scorers import JOINT_MODELS, LinearScorer, Rule, RuleListScorer
from evenhand.plans import audit

GROUPS = ("a", "b", "c")
ENCODER = Encoder((NumericFeature("n"),), (CategoricalBlock("s", GROUPS),))
LINEAR = LinearScorer("linear", ENCODER, {"n": 1.0, "s=a": 0.3, "s=b": -0.4, "s=c": 0.1}, 0.05)
EQUAL = LinearScorer("equal", ENCODER, {"n": 1.0, "s=a": 0.2, "s=b": 0.2, "s=c": 0.2})
RULES = RuleListScorer("rules", ENCODER, (Rule((("s=b", ">", 0.5), ("n", ">", 0.0)), 0, 0.2), Rule((("n", ">", -0.5),), 1, 0.8)))


def _frame(spark, n=200, groups=GROUPS, null_every=0, seed=5, **kw):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = None if null_every and i % null_every == 0 else rng.choice(groups)
        rows.append((i * 3, rng.uniform(-1, 1), g, rng.randint(0, 1)))
    df = spark.createDataFrame(rows, "id bigint, n double, s string, label int")
    return AuditFrame(df, "label", "s", ("n",), ("s",), row_id="id", **kw)


def _brute(frame, scorers, groups):
    rows = frame.df.collect()
    preds = {}
    for m in scorers:
        for g in (*groups, None):
            one = frame.df.withColumn("s", F.lit(g).cast("string"))
            preds[m.name, g] = {r["id"]: r["p"] for r in one.select("id", m().pred.alias("p")).collect()}
    return rows, preds


@pytest.mark.parametrize("null_every", [0, 4])
def test_counts_equal_details_and_brute_force(spark, null_every):
    f = _frame(spark, null_every=null_every)
    models = [LINEAR, EQUAL, RULES]
    rows, preds = _brute(f, models, GROUPS)
    details = probes.full_probe(f, models)
    summary = {
        r["model"]: r for r in probes.full_probe_counts(probes.response_counts(f, models, list(GROUPS)), list(GROUPS)).collect()
    }
    for m in models:
        expected = [
            (r["id"], r["s"], g, preds[m.name, r["s"]][r["id"]], preds[m.name, g][r["id"]])
            for r in rows for g in GROUPS if g != r["s"]
        ]
        got = [(r["row_index"], r["orig_group"], r["alt_group"], r["pred_orig"], r["pred_cf"])
               for r in details.filter(F.col("model") == m.name).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
        flips = sum(a != b for *_, a, b in expected)
        assert (summary[m.name]["total_checks"], summary[m.name]["flip_count"]) == (len(expected), flips)
        right = sum(r["label"] == preds[m.name, r["s"]][r["id"]] for r in rows)
        assert summary[m.name]["accuracy"] == pytest.approx(right / len(rows))
    assert summary["equal"]["flip_count"] == 0 or null_every


def test_pairs_equal_brute_force(spark):
    f = _frame(spark, null_every=7)
    models = [LINEAR, EQUAL, RULES]
    rows, preds = _brute(f, models, GROUPS)
    got = {(r["model"], r["source_group"], r["target_group"]): r for r in paircheck.observed_pairs(f, models).collect()}
    assert len(got) == 3 * 6
    for (model, a, b), r in got.items():
        bad = [x["id"] for x in rows if preds[model, a][x["id"]] != preds[model, b][x["id"]]]
        assert (r["violations"], r["rows_checked"], r["first_row"]) == (len(bad), len(rows), min(bad, default=None))
        assert r["status"] == ("sat" if bad else "unsat")
    docs = {r["model"]: r for r in audit.observed_documents(f, models, "d").collect()}
    assert docs["equal"]["overall_status"] == "UNSAT" and docs["equal"]["first_counterexample"] is None
    ce = docs["linear"]["first_counterexample"]
    assert docs["linear"]["overall_status"] == "SAT" and ce["prediction_x"] != ce["prediction_y"]
    assert ce["example_x"]["n"] == ce["example_y"]["n"] and ce["example_x"]["s"] == ce["source_group"]
    with_example = [p for p in docs["linear"]["pair_checks"] if p["example_x"]]
    assert len(with_example) == 1 and len(docs["linear"]["pair_checks"]) == 6
    assert docs["rules"]["num_rules"] == 2 and docs["linear"]["logreg_intercept"] == 0.05


def test_more_groups_than_bits(spark):
    groups = [f"g{i:03d}" for i in range(70)]
    encoder = Encoder((NumericFeature("n"),), (CategoricalBlock("s", tuple(groups)),))
    model = LinearScorer("m", encoder, {"n": 1.0, **{f"s={g}": (i - 35) / 40 for i, g in enumerate(groups)}})
    f = _frame(spark, 60, groups)
    counts = probes.response_counts(f, [model], groups)
    assert "mask_1" in counts.columns
    totals = probes.full_probe_counts(counts, groups).first()
    details = probes.full_probe(f, [model], groups).agg(F.count("*"), F.sum("flipped")).first()
    assert (totals["total_checks"], totals["flip_count"]) == tuple(details) == (60 * 69, details[1])
    pairs = paircheck.observed_pairs(f, [model], groups)
    assert pairs.count() == 70 * 69
    first = pairs.filter("source_group = 'g000' and target_group = 'g069'").first()
    low, high = (set(r["id"] for r in f.df.filter(F.col("n") + w > 0).collect()) for w in (-35 / 40, 34 / 40))
    assert first["violations"] == len(high - low)


def test_more_than_a_thousand_groups(spark):
    """One expression for all groups, and no line for a pair that no pattern tells apart before the last join."""
    groups = [f"g{i:04d}" for i in range(1_050)]
    weights = {f"s={g}": (-1.0 if i % 350 == 0 else 0.0) for i, g in enumerate(groups)}
    model = LinearScorer("m", Encoder((NumericFeature("n"),), (CategoricalBlock("s", tuple(groups)),)), {"n": 1.0, **weights})
    f = _frame(spark, 40, groups[:25])
    seen = f.with_df(f.df.unionByName(spark.createDataFrame([(9_000 + i, 0.5, g, 1) for i, g in enumerate(groups)], "id bigint, n double, s string, label int")))
    assert metrics.resolve_groups(seen) == groups
    pairs = paircheck.observed_pairs(seen, [model])
    n = seen.df.filter((F.col("n") > 0) & (F.col("n") <= 1)).count()
    got = pairs.groupBy("status", "violations").count().collect()
    assert {(r["status"], r["violations"]): r["count"] for r in got} == {("sat", n): 2 * 3 * 1_047, ("unsat", 0): 1_050 * 1_049 - 2 * 3 * 1_047}
    assert paircheck.group_pairs(seen.df, "s").count() == 1_050 * 1_049
    counts = probes.response_counts(f, [model], groups)
    total = probes.full_probe_counts(counts, groups).first()
    details = probes.full_probe(f, [model], groups).agg(F.count("*"), F.sum("flipped")).first()
    assert (total["total_checks"], total["flip_count"]) == tuple(details)


def test_both_forms_of_the_patterns_agree(spark, monkeypatch):
    f = _frame(spark, null_every=5)
    order = ["model", "label", "grp", "pred", "mask_0", "n"]
    inline = probes.response_counts(f, [LINEAR, RULES], list(GROUPS)).orderBy(*order).collect()
    monkeypatch.setattr(probes, "INLINE_GROUPS", 2)
    assert probes.response_counts(f, [LINEAR, RULES], list(GROUPS)).orderBy(*order).collect() == inline


def test_a_missing_prediction_is_no_check(spark):
    f = _frame(spark)
    gaps = f.with_df(f.df.withColumn("n", F.when(F.col("id") % 4 > 0, F.col("n"))))
    n = gaps.df.count()
    known = gaps.df.filter("n is not null").count()
    assert 0 < known < n
    report = {r["baseline"]: r for r in audit.probe_report(gaps, [LINEAR], "d", 5000, 5000).collect()}
    whole, random_one, near = (report[b] for b in ("counterfactual_augmentation", "random_pair_sampling", "boundary_focused_sampling"))
    assert whole["total_checks"] == 2 * known and near["total_checks"] == 2 * known
    assert near["top_k"] == n and random_one["n_samples"] == random_one["total_checks"] < n
    assert whole["flip_count"] == probes.full_probe(gaps, [LINEAR]).agg(F.sum("flipped")).first()[0]
    assert {r["rows_checked"] for r in paircheck.observed_pairs(gaps, [LINEAR]).collect()} == {known}


def test_nearest_rows_of_all_models_in_one_scan(spark, monkeypatch):
    monkeypatch.setattr(probes, "DISTANCE_BUCKETS", 16)
    f = _frame(spark, 700)
    flat = LinearScorer("flat", ENCODER, {}, 0.0)  # every row has the same distance
    for k in (1, 37, 600, 701):
        got = probes.nearest_rows(f, [LINEAR, RULES, flat], k)
        for m in (LINEAR, RULES, flat):
            nearest = f.df.select("id", F.abs(m().proba - 0.5).alias("d")).orderBy("d", "id").limit(k).collect()
            own = got.filter(F.col("model") == m.name).select("id", "_distance").collect()
            assert sorted((r["id"], r["_distance"]) for r in own) == sorted((r["id"], r["d"]) for r in nearest)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_many_models_take_the_other_path(spark):
    f = _frame(spark)
    many = [LinearScorer(f"m{i}", ENCODER, {"n": 1.0, "s=a": i / 10}) for i in range(JOINT_MODELS + 2)]
    one_by_one = {}
    for m in many:
        one_by_one[m.name] = metrics.quality(metrics.prediction_counts(f, [m])).first()["accuracy"]
    together = {r["model"]: r["accuracy"] for r in metrics.quality(metrics.prediction_counts(f, many)).collect()}
    assert together == pytest.approx(one_by_one)


def test_two_groups_are_symmetric(spark):
    f = _frame(spark, groups=("a", "b"))
    pairs = {(r["source_group"], r["target_group"]): r["violations"] for r in paircheck.observed_pairs(f, [LINEAR]).collect()}
    assert pairs["a", "b"] == pairs["b", "a"]
    flips = probes.full_probe(f, [LINEAR]).agg(F.sum("flipped")).first()[0]
    swap = metrics.binary_flip_rate(f, [LINEAR]).first()
    assert swap["cf_flips"] == flips == pairs["a", "b"]
    assert swap["cf_flip_rate"] == pytest.approx(flips / 200)
    assert metrics.binary_flip_rate(_frame(spark), [LINEAR]).first()["cf_flips"] is None


def test_random_probe(spark):
    for f in (_frame(spark), _frame(spark, null_every=3)):
        out = probes.random_probe(f, [LINEAR, RULES], 50)
        rows = out.filter("model = 'linear'").collect()
        assert len(rows) == 50 and all(r["orig_group"] != r["alt_group"] for r in rows)
        assert {r["row_index"] for r in rows} <= {r["id"] for r in f.df.collect()}
        assert out.exceptAll(probes.random_probe(f, [LINEAR, RULES], 50)).count() == 0
        assert len({r["row_index"] for r in rows}) < 50  # with replacement
    assert probes.random_probe(_frame(spark, 10), [LINEAR], 50).count() == 10
    assert probes.random_probe(_frame(spark, 10, groups=("a",)), [LINEAR], 50).count() == 0


def test_a_false_claim_of_dense_ids_loses_no_draw(spark):
    claimed = _frame(spark, dense=True)  # its ids are multiples of three
    assert probes.random_probe(claimed, [LINEAR], 50).exceptAll(probes.random_probe(_frame(spark), [LINEAR], 50)).count() == 0
    right = claimed.with_df(claimed.df.withColumn("id", (F.col("id") / 3).cast("bigint")))
    assert probes.random_probe(claimed, [LINEAR], 50).count() == probes.random_probe(right, [LINEAR], 50).count() == 50


@pytest.mark.parametrize("k", [1, 30, 5000])
def test_boundary_probe(spark, k):
    f = _frame(spark)
    out = probes.boundary_probe(f, [LINEAR, RULES], k)
    scored = f.df.select("id", F.abs(LINEAR().proba - 0.5).alias("d")).orderBy("d", "id").limit(k).collect()
    got = out.filter("model = 'linear'").select("row_index", "boundary_distance").distinct().collect()
    assert {r["row_index"] for r in got} == {r["id"] for r in scored}
    assert out.count() == 2 * min(k, 200) * 2
    tied = out.filter("model = 'rules'").select("row_index", "boundary_distance").distinct().orderBy("boundary_distance", "row_index")
    assert len(tied.collect()) == min(k, 200)


def test_edges(spark):
    blind = LinearScorer("blind", ENCODER.without("s"), {"n": 1.0}, include_sensitive=False)
    f = _frame(spark)
    with pytest.raises(ValueError, match="not a feature"):
        probes.full_probe(f, [blind])
    assert probes.full_probe(f, [blind], allow_blind=True).agg(F.sum("flipped")).first()[0] == 0
    assert {r["status"] for r in paircheck.observed_pairs(f, [blind]).collect()} == {"unsat"}
    empty = f.with_df(f.df.filter("id < 0"))
    report = audit.probe_report(empty, [LINEAR], "d", 5, 5)
    assert report.count() == 0
    one = _frame(spark, groups=("a",))
    rates = {r["baseline"]: r for r in audit.probe_report(one, [LINEAR], "d", 5, 5).collect()}
    assert all(r["flip_rate"] == 0.0 and r["total_checks"] == 0 for r in rates.values())
    document = audit.observed_documents(one, [LINEAR], "d").first()
    assert (document["overall_status"], document["pair_checks"], document["ce_found"]) == ("UNSAT", [], 0)
    assert paircheck.observed_pairs(one, [LINEAR]).count() == 0 == paircheck.observed_pairs(empty, [LINEAR]).count()
    no_id = AuditFrame(f.df, "label", "s", ("n",), ("s",))
    with pytest.raises(ValueError, match="row id"):
        probes.boundary_probe(no_id, [LINEAR], 5)


def test_f1_and_gap_edges(spark):
    f = _frame(spark)
    never = LinearScorer("never", ENCODER, {}, -1.0)
    zero = f.with_df(f.df.withColumn("label", F.lit(0)))
    row = metrics.experiment_summary(zero, [never], "d").first()
    assert (row["f1"], row["accuracy"], row["dp_gap"]) == (0.0, 1.0, 0.0) and set(row["dp_rates"]) == set(GROUPS)
    nobody = f.with_df(f.df.withColumn("s", F.lit(None).cast("string")))
    row = metrics.experiment_summary(nobody, [LINEAR], "d").first()
    assert row["dp_gap"] is None and row["dp_rates"] == {}


def test_overall_status(spark):
    pairs = spark.createDataFrame(
        [("m1", "sat"), ("m1", "unknown"), ("m2", "unsat"), ("m2", "unknown"), ("m3", "unsat")], "model string, status string"
    )
    got = {r["model"]: (r["overall_status"], r["ce_found"]) for r in paircheck.overall_status(pairs).collect()}
    assert got == {"m1": ("SAT", 1), "m2": ("UNKNOWN", 0), "m3": ("UNSAT", 0)}
    more = spark.createDataFrame([("m1",), ("m4",)], "model string")
    got = {r["model"]: (r["overall_status"], r["checked_pairs"]) for r in paircheck.overall_status(pairs, models=more).collect()}
    assert got == {"m1": ("SAT", 2), "m4": ("UNSAT", 0)}
