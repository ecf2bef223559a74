"""Reports against published result rows (inlined)."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenhand.functions import text
from evenhand.operators import clean
from evenhand.plans import gate, reports

EXPERIMENTS = [
    ("scholarship", "tree", True, "Asal_Daerah", 0.855, 0.7289719626168224, 0.10991022400418374),
    ("scholarship", "tree", False, "Asal_Daerah", 0.855, 0.7289719626168224, None),
    ("scholarship", "logreg", True, "Asal_Daerah", 0.915, 0.839622641509434, 0.052456992980020045),
    ("scholarship", "logreg", False, "Asal_Daerah", 0.9175, 0.8450704225352113, None),
    ("adult", "tree", True, "sex", 0.8520361157177078, 0.624590930341281, 0.15405222783099487),
    ("adult", "tree", False, "sex", 0.8520361157177078, 0.624590930341281, None),
    ("adult", "logreg", True, "sex", 0.8507462686567164, 0.6501583645263461, 0.1756613069085743),
    ("adult", "logreg", False, "sex", 0.8506848473680978, 0.6488516539072656, None),
    ("adult", "rulelist", True, "sex", 0.8447884036607088, 0.606814999222032, 0.144464182160434),
    ("adult", "rulelist", False, "sex", 0.8447884036607088, 0.606814999222032, None),
    ("german_credit", "tree", True, "sex", 0.6966666666666667, 0.7955056179775281, 0.01225490196078427),
    ("german_credit", "tree", False, "sex", 0.6966666666666667, 0.7955056179775281, None),
    ("german_credit", "logreg", True, "sex", 0.74, 0.8211009174311927, 0.1121323529411764),
    ("german_credit", "logreg", False, "sex", 0.74, 0.8211009174311927, None),
    ("german_credit", "rulelist", True, "sex", 0.7133333333333334, 0.8193277310924371, 0.05943627450980393),
    ("german_credit", "rulelist", False, "sex", 0.7133333333333334, 0.8193277310924371, None),
]
REMOVAL = {
    ("scholarship", "Decision Tree"): (0.0, 0.0, 0.1099102240041837),
    ("scholarship", "Logistic Regression"): (0.0024999999999999467, 0.005447781025777254, 0.05245699298002),
    ("adult", "Decision Tree"): (0.0, 0.0, 0.1540522278309948),
    ("adult", "Logistic Regression"): (-6.142128861863494e-05, -0.0013067106190804978, 0.1756613069085743),
    ("adult", "Rule List"): (0.0, 0.0, 0.144464182160434),
    ("german_credit", "Decision Tree"): (0.0, 0.0, 0.0122549019607842),
    ("german_credit", "Logistic Regression"): (0.0, 0.0, 0.1121323529411764),
    ("german_credit", "Rule List"): (0.0, 0.0, 0.0594362745098039),
}
# dataset, model: random, full and boundary flip rates, strongest probe
RATES = {
    ("scholarship", "logreg"): (0.01, 0.005, 0.02, "boundary_focused_sampling"),
    ("scholarship", "rulelist"): (0.0, 0.0, 0.0, "random_pair_sampling"),
    ("scholarship", "tree"): (0.0, 0.0, 0.0, "random_pair_sampling"),
    ("adult", "logreg"): (0.084, 0.08924513236287697, 0.504, "boundary_focused_sampling"),
    ("adult", "rulelist"): (0.0, 0.0, 0.0, "random_pair_sampling"),
    ("adult", "tree"): (0.0, 0.0, 0.0, "random_pair_sampling"),
    ("german_credit", "logreg"): (0.04, 0.023333333333333334, 0.023333333333333334, "random_pair_sampling"),
    ("german_credit", "rulelist"): (0.0, 0.0, 0.0, "random_pair_sampling"),
    ("german_credit", "tree"): (0.0, 0.0, 0.0, "random_pair_sampling"),
}
SENSITIVE = {"scholarship": "Asal_Daerah", "adult": "sex", "german_credit": "sex"}
DATASETS = ("scholarship", "adult", "german_credit")
MODELS = ("Decision Tree", "Rule List", "Logistic Regression")
PAIRS = {"scholarship": ("3T", "Pedesaan", 6), "adult": ("Female", "Male", 2), "german_credit": ("female", "male", 2)}
SCORES = {
    "scholarship": ("19715089434651473/100000000000000000", 0.1971508943465147),
    "adult": ("10368279548611263/12500000000000000", 0.8294623638889012),
    "german_credit": ("3727060284807609/40000000000000000", 0.0931765071201902),
}


@pytest.fixture(scope="module")
def experiments(spark):
    return spark.createDataFrame(
        EXPERIMENTS,
        "dataset string, model string, include_sensitive boolean, sensitive_attribute string, accuracy double, f1 double, dp_gap double",
    ).withColumn("dp_rates", F.lit("{}"))


@pytest.fixture(scope="module")
def probes(spark):
    rows = [
        (probe, d, m, SENSITIVE[d], rates[i])
        for (d, m), rates in RATES.items()
        for i, probe in enumerate(reports.PROBES)
    ]
    return spark.createDataFrame(rows, "baseline string, dataset string, model string, sensitive_attribute string, flip_rate double")


@pytest.fixture(scope="module")
def documents(spark):
    rows = []
    for d in DATASETS:
        src, dst, n = PAIRS[d]
        for m in MODELS:
            sat = m == "Logistic Regression"
            checks = [(src, dst, "sat" if sat else "unsat")] * n
            ce = None
            if sat:
                same = {"duration_months": "21.0", "job": "A172"}
                s = SENSITIVE[d]
                ce = (src, dst, "sat", "0", SCORES[d][0], "0", "1", {**same, s: src}, {**same, s: dst})
            rows.append((d, m, SENSITIVE[d], "SAT" if sat else "UNSAT", checks, ce, 0.3, False, 100, n if sat else 0))
    pair = "struct<source_group:string,target_group:string,status:string>"
    ce = (
        "struct<source_group:string,target_group:string,status:string,score_x:string,score_y:string,prediction_x:string,"
        "prediction_y:string,example_x:map<string,string>,example_y:map<string,string>>"
    )
    return spark.createDataFrame(
        rows,
        f"dataset string, model string, sensitive_attribute string, overall_status string, pair_checks array<{pair}>, "
        f"first_counterexample {ce}, runtime_seconds double, timeout boolean, ce_bound bigint, ce_found bigint",
    )


def test_removal_ablation(experiments):
    got = {(r["dataset"], r["model"]): r for r in reports.removal_ablation(experiments).collect()}
    assert set(got) == set(REMOVAL)
    for key, (da, df, gap) in REMOVAL.items():
        r = got[key]
        assert (r["delta_accuracy"], r["delta_f1"], r["dp_gap_with_sensitive"]) == pytest.approx((da, df, gap), abs=1e-12)


def test_probe_ablation(probes):
    got = {(r["dataset"], r["model"]): r for r in reports.probe_ablation(probes).collect()}
    assert len(got) == 9
    for (d, m), (a, b, c, strongest) in RATES.items():
        r = got[d, reports.MODEL_NAMES[m]]
        assert (r["random_flip_rate"], r["counterfactual_flip_rate"], r["boundary_flip_rate"]) == (a, b, c)
        assert r["strongest_baseline"] == strongest


def test_final_summary_order_and_gaps(experiments, probes):
    rows = reports.final_summary(experiments, probes.filter("dataset <> 'adult'")).collect()
    assert [(r["dataset"], r["model"]) for r in rows] == [
        ("scholarship", "Decision Tree"), ("scholarship", "Logistic Regression"),
        ("adult", "Decision Tree"), ("adult", "Logistic Regression"), ("adult", "Rule List"),
        ("german_credit", "Decision Tree"), ("german_credit", "Logistic Regression"), ("german_credit", "Rule List"),
    ]
    assert rows[2]["baseline_random_flip_rate"] is None and rows[1]["baseline_boundary_flip_rate"] == 0.02


def test_solver_summary_and_gate(spark, documents):
    summary = reports.solver_summary(documents)
    rows = summary.collect()
    assert [(r["dataset"], r["model"]) for r in rows] == [(d, m) for d in DATASETS for m in MODELS]
    assert [r["first_counterexample_pair"] for r in rows if r["has_counterexample"]] == [
        "3T -> Pedesaan", "Female -> Male", "female -> male"
    ]
    assert rows[0]["checked_pairs"] == 6 and rows[0]["ci_status"] == "PASS"
    assert tuple(reports.status_counts(summary).first()) == (6, 3, 0, 9)
    agreement = spark.createDataFrame(
        [(d, m, n, 0) for d, n in (("adult", 1000), ("german_credit", 300), ("scholarship", 400)) for m in MODELS],
        "dataset string, model string, samples_checked bigint, mismatch_count bigint",
    )
    assert tuple(reports.agreement_totals(agreement).first()) == (9, 5100, 0, 100.0)
    doc = gate.gate_document(summary, agreement, {"summary": "s.json"}).first()
    assert (doc["overall_status"], doc["exit_code"], tuple(doc["counts"])) == ("FAIL", 1, (6, 3, 0, 9))
    assert doc["failed_models"] == [f"{d} / Logistic Regression" for d in DATASETS]
    assert doc["passed_models"] == [f"{d} / {m}" for d in DATASETS for m in MODELS[:2]] and doc["warning_models"] == []
    assert tuple(doc["encoder_validation"]) == (9, 5100, 0, 100.0, "PASS") and doc["inputs"]["summary"] == "s.json"
    assert gate.gate_document(summary).first()["encoder_validation"] is None
    assert gate.result_table(summary).count() == 9


def test_counterexample_and_root_cause_reports(documents):
    summary = reports.solver_summary(documents)
    report = reports.counterexample_report(summary, documents)
    got = {r["dataset"]: r for r in report.collect()}
    assert set(got) == set(DATASETS)
    for d, r in got.items():
        assert (r["prediction_x"], r["prediction_y"], r["score_x_raw"], r["score_x_float"]) == ("0", "1", "0", 0.0)
        assert r["score_y_float"] == pytest.approx(SCORES[d][1], abs=1e-12)
        assert r["changed_features_count"] == 1
        assert r["changed_features"] == f"{SENSITIVE[d]}: {PAIRS[d][0]} -> {PAIRS[d][1]}"
    causes = {r["dataset"]: r for r in reports.root_cause_report(report).collect()}
    assert causes["scholarship"]["root_cause"] == "Sensitive region attribute change causes decision-boundary crossing"
    assert causes["scholarship"]["suggested_action"] == (
        "Remove regional attribute from training or apply fairness-aware retraining"
    )
    assert causes["adult"]["root_cause"] == "Sensitive attribute change causes decision-boundary crossing"
    assert causes["adult"]["boundary_distance"] == pytest.approx(0.8294623638889012, abs=1e-12)
    assert reports.missing_details(summary, documents).count() == 0
    partial = documents.filter("dataset <> 'adult'")
    assert reports.missing_details(summary, partial).count() == 1
    with pytest.raises(PySparkException, match="no detail document"):
        reports.counterexample_report(summary, partial).collect()


@pytest.mark.parametrize(
    ("statuses", "expected"),
    [
        (["PASS", "pass"], ("PASS", 0)),
        (["PASS", "WARNING"], ("WARNING", 2)),
        (["WARNING", "FAIL"], ("FAIL", 1)),
        (["PASS", "odd"], ("WARNING", 2)),
        (["PASS", None], ("WARNING", 2)),
        ([], ("WARNING", 2)),
    ],
)
def test_gate_rules(spark, statuses, expected):
    rows = [(f"d{i}", "m", s) for i, s in enumerate(statuses)]
    summary = spark.createDataFrame(rows, "dataset string, model string, ci_status string")
    out = gate.gate(summary).first()
    assert (out["overall_status"], out["exit_code"]) == expected
    assert out["n_pass"] + out["n_fail"] + out["n_warning"] == out["n_total"] == len(statuses)


def test_failed_agreement_does_not_block(spark, documents):
    rows = spark.createDataFrame([("d", "m", 10, 3)], "dataset string, model string, samples_checked bigint, mismatch_count bigint")
    doc = gate.gate_document(reports.solver_summary(documents.filter("overall_status = 'UNSAT'")), rows).first()
    assert doc["overall_status"] == "PASS" and tuple(doc["encoder_validation"])[2:] == (3, 70.0, "FAIL")
    empty = reports.agreement_totals(rows.filter("mismatch_count > 99")).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_scalar_rules(spark):
    df = spark.createDataFrame(
        [("3/4",), ("1/0",), ("x",), (None,), (" 2.5 ",), ("1e3",), ("7d",), ("-1/8",), ("1/2/3",)], "v string"
    )
    assert [r[0] for r in df.select(text.parse_number(F.col("v"))).collect()] == [
        0.75, None, None, None, 2.5, 1000.0, None, -0.125, None
    ]
    df = spark.createDataFrame([("0",), ("1.0",), ("2",), ("yes",), (" 0.0 ",), (None,)], "v string")
    assert [r[0] for r in df.select(text.normalise_prediction(F.col("v"))).collect()] == ["0", "1", "2", "yes", "0", None]
    df = spark.createDataFrame([("sat",), ("UNSAT",), ("unknown",), (None,)], "v string")
    assert [r[0] for r in df.select(text.gate_status(F.col("v"))).collect()] == ["FAIL", "PASS", "WARNING", "WARNING"]
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(text.pair_text(F.col("x"), F.col("y"))).collect()] == ["a -> b", None, None]


def test_example_diff_edges(spark):
    rows = [({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"a": "1"}), ({"a": None}, {"a": None}), ({}, {})]
    df = spark.createDataFrame(rows, "x map<string,string>, y map<string,string>")
    diff = text.example_diff(F.col("x"), F.col("y"))
    got = [(r["t"], r["n"]) for r in df.select(text.diff_text(diff).alias("t"), F.size(diff).alias("n")).collect()]
    assert got == [("a: 1 -> None; b: 2 -> 3; c: None -> 4", 3), ("", 0), ("", 0), ("", 0)]


def test_order_by_categories(spark):
    df = spark.createDataFrame([("x",), ("b",), ("a",), (None,)], "v string")
    assert [r[0] for r in clean.order_by_categories(df, {"v": ["b", "a"]}).collect()][:2] == ["b", "a"]


def test_interpretation_covers_the_statuses(spark):
    assert {r["status"] for r in reports.interpretation_table(spark).collect()} == {"UNSAT", "SAT", "OTHER"}
