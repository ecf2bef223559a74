"""A whole audit, from training rows to the gate."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evenhand import AuditFrame
from evenhand.operators.splits import hash_split
from evenhand.plans import audit


def test_full_audit(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        s, x, c = rng.choice("ab"), rng.gauss(0, 1), rng.choice("uvw")
        y = int(x + (1.5 if s == "a" else 0.0) + rng.gauss(0, 0.5) > 0.5)
        rows.append((i, x, c, s, y))
    df = hash_split(spark.createDataFrame(rows, "id bigint, x double, c string, s string, y int"), "id", 0.3)
    train, test = (
        AuditFrame(df.filter(F.col("split") == part), "y", "s", ("x",), ("c", "s"), row_id="id") for part in ("train", "test")
    )
    out = audit.full_audit(train, test, "toy", draws=40, nearest=20)
    experiments = {(r["model"], r["include_sensitive"]): r for r in out.experiments.collect()}
    assert len(experiments) == 6
    assert experiments["logreg", True]["accuracy"] > 0.75 and experiments["logreg", True]["dp_gap"] > 0.1
    assert experiments["logreg", False]["dp_gap"] is None
    probes = {(r["model"], r["baseline"]): r for r in out.probes.collect()}
    assert len(probes) == 9
    assert probes["logreg", "boundary_focused_sampling"]["top_k"] == 20
    assert probes["logreg", "boundary_focused_sampling"]["flip_rate"] > 0.5
    n_test = test.df.count()
    assert probes["logreg", "counterfactual_augmentation"]["total_checks"] == n_test
    solver = {r["model"]: r for r in out.solver_summary.collect()}
    assert solver["Logistic Regression"]["solver_status"] == "SAT"
    assert solver["Logistic Regression"]["first_counterexample_pair"] == "a -> b"
    report = [r for r in out.counterexamples.collect() if r["model"] == "Logistic Regression"][0]
    assert report["changed_features"] == "s: a -> b" and (report["prediction_x"], report["prediction_y"]) == ("1", "0")
    assert all(r["mismatch_count"] == 0 for r in out.agreement.collect())
    gate = out.gate.first()
    assert (gate["overall_status"], gate["exit_code"], gate["encoder_validation"]["status"]) == ("FAIL", 1, "PASS")
    assert "toy / Logistic Regression" in gate["failed_models"]
