"""Categorical columns as tables: the same results as with one expression per category."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand import AuditFrame
from evenhand.operators import agreement, boxcheck, fitting, metrics, paircheck, probes, profiled
from evenhand.operators import scorers as S
from evenhand.operators.features import DictionaryBlock, fit_encoder
from evenhand.plans import audit


@pytest.fixture(scope="module")
def frame(spark):
    dice = random.Random(5)
    rows = []
    for i in range(500):
        city, job = f"c{dice.randrange(40)}" if dice.random() > 0.1 else None, dice.choice(["it's", "b=x", "d\\e", "f"])
        x, s = dice.gauss(0, 1) if dice.random() > 0.1 else None, dice.choice("pqr")
        rows.append((i, x, city, job, s, int((x or 0) + (city in ("c1", "c2", "c3")) - 0.3 * (s == "p") + dice.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, "id int, x double, city string, job string, s string, y int")
    return AuditFrame(df, "y", "s", ("x",), ("city", "job", "s"), row_id="id")


@pytest.fixture(scope="module")
def encoders(frame):
    return fit_encoder(frame), fit_encoder(frame, inline=3)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_blocks(frame, encoders):
    narrow, wide = encoders
    assert [type(b).__name__ for b in wide.blocks] == ["DictionaryBlock", "DictionaryBlock", "CategoricalBlock"]
    assert not narrow.dictionaries and narrow.size == wide.size and narrow.offsets() == wide.offsets()
    assert [b.mode for b in narrow.blocks] == [b.mode for b in wide.blocks]
    only_city = fit_encoder(frame, inline=10)
    assert [b.source for b in only_city.dictionaries] == ["city"]
    assert fit_encoder(frame, inline=40).dictionaries == [] and len(fit_encoder(frame, inline=39).dictionaries) == 1
    with pytest.raises(ValueError, match="schema_table"):
        wide.names()
    some = [0, 1, 7, narrow.size - 1, 42]
    assert wide.names_at(some) == {p: narrow.names()[p] for p in some}


def test_schema_bounds_and_vectors_are_the_same(spark, frame, encoders):
    narrow, wide = encoders
    assert rows_of(wide.schema_table(spark), "position") == rows_of(narrow.schema_table(spark), "position")
    assert rows_of(wide.bounds_table(frame.df), "feature") == rows_of(narrow.bounds_table(frame.df), "feature")
    dense = {r["id"]: list(r)[1:] for r in narrow.transform(frame.df, ["id"]).collect()}
    for encoder in encoders:
        sparse = {r["id"]: r["features"].toArray().tolist() for r in encoder.vectors(frame.df, ["id"]).collect()}
        assert sparse == dense
    new = spark.createDataFrame([(9, None, "unseen", None, "zz", 1)], frame.df.schema)
    narrow_row, wide_row = ({tuple(r["features"].toArray()) for r in e.vectors(new, ["id"]).collect()} for e in encoders)
    assert narrow_row == wide_row


def test_decode_and_one_hot_check(frame, encoders):
    narrow, wide = encoders
    back = [rows_of(e.decode(e.transform(frame.df, ["id"]), ["id"]).withColumn("x", F.round("x", 9)), "id") for e in encoders]
    assert back[0] == back[1]
    checks = [rows_of(paircheck.block_violations(e.transform(frame.df, ["id"]), e), "source_col") for e in encoders]
    assert checks[0] == checks[1]


def test_fits_scores_and_audits_are_the_same(spark, frame, encoders):
    fitted = [{k: fitting.fit(k, frame, encoder=e) for k in fitting.KINDS} for e in encoders]
    for kind in fitting.KINDS:
        row = agreement.check_fitted(fitted[1][kind], frame.df, "id", "d").first()
        assert (row["samples_checked"], row["mismatch_count"], row["match_rate"]) == (500, 0, 100.0)
        scored = [rows_of(S.score_models(frame.df, [f[kind].scorer], ["id"]).select("id", F.round("proba", 5), "pred"), "id") for f in fitted]
        assert scored[0] == scored[1]
    several = [[f[k].scorer for k in fitting.KINDS] for f in fitted]
    for run in (
        lambda m: rows_of(metrics.quality(metrics.prediction_counts(frame, m)), "model"),
        lambda m: rows_of(probes.full_probe(frame, m), "model", "row_index", "alt_group"),
        lambda m: rows_of(probes.random_probe(frame, m, 60), "model", "row_index", "alt_group"),
        lambda m: rows_of(probes.boundary_probe(frame, m, 20).select("model", "row_index", "alt_group", "flipped"), "model", "row_index", "alt_group"),
        lambda m: rows_of(paircheck.observed_pairs(frame, m), "model", "source_group", "target_group"),
        lambda m: rows_of(
            audit.observed_documents(frame, m, "d").select("model", "overall_status", "first_counterexample.prediction_x"), "model"
        ),
        lambda m: rows_of(audit.box_documents(frame, m, "d").select("model", "overall_status", "ce_found"), "model"),
    ):
        assert run(several[0]) == run(several[1])
    weights = [rows_of(S.weight_table(spark, [m[1]]).withColumn("weight", F.round("weight", 5)), "feature") for m in several]
    assert weights[0] == weights[1]
    terms = boxcheck.linear_terms(S.weight_table(spark, [several[1][1]]), encoders[1].schema_table(spark), encoders[1].bounds_table(frame.df))
    assert terms.count() == encoders[1].size + 1


def test_pinning_a_dictionary_column_is_an_error(frame, encoders):
    scorer = fitting.fit("logreg", frame, encoder=encoders[1]).scorer
    with pytest.raises(ValueError, match="dictionary"):
        scorer(lambda c: "'c1'" if c == "city" else f"`{c}`")
    assert isinstance(encoders[1].block("city"), DictionaryBlock) and encoders[1].without("city").block("city") is None


def test_one_wide_column_is_fitted_without_the_librarys_learner(spark, frame, monkeypatch):
    """The learner keeps dense vectors of all weights on the driver; a wide column's weights stay a table."""
    narrow, wide = fit_encoder(frame), fit_encoder(frame, inline=10)
    told = fitting.fit("logreg", frame, encoder=narrow)
    monkeypatch.setattr(fitting.LogisticRegression, "fit", lambda *_: pytest.fail("MLlib's learner was called"))
    weights = []
    for rows in (200_000, 30):  # slots in one partition, and shared by partitions and chunks
        monkeypatch.setattr(profiled, "PARTITION", rows)
        monkeypatch.setattr(profiled, "cells", lambda k, n=rows: n // 3 + 1)
        found = fitting.fit("logreg", frame, encoder=wide)
        weights.append([found.model.intercept, *found.model.coefficients.toArray()])
        assert weights[-1] == pytest.approx([told.model.intercept, *told.model.coefficients.toArray()], abs=1e-5)
        row = agreement.check_fitted(found, frame.df, "id", "d").first()
        assert (row["samples_checked"], row["mismatch_count"], row["match_rate"]) == (500, 0, 100.0)
    assert weights[0] == pytest.approx(weights[1], abs=1e-10)


def test_a_wide_fit_is_the_optimum(spark, frame):
    found = fitting.fit("logreg", frame, encoder=fit_encoder(frame, inline=10))
    w, b = found.model.coefficients.toArray(), found.model.intercept
    gradient, total = w.copy(), 0.0
    for r in fitting._training_rows(frame, found.encoder).collect():
        x = r["features"].toArray()
        error = 1 / (1 + math.exp(-(x @ w + b))) - r["_label"]
        gradient += error * x
        total += error
    assert abs(gradient).max() < 1e-9 and abs(total) < 1e-9


def test_one_label_and_hot_values(spark):
    rows = [(i, float(i % 7), f"c{i % 600}" if i % 3 else "hot", "pq"[i % 2], 1) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, x double, city string, s string, y int")
    same = AuditFrame(df, "y", "s", ("x",), ("city", "s"), row_id="id")
    assert agreement.check_fitted(fitting.fit("logreg", same), df, "id", "d").first()["mismatch_count"] == 0
    mixed = AuditFrame(df.withColumn("y", (F.col("id") % 5 < 2).cast("int")), "y", "s", ("x",), ("city", "s"), row_id="id")
    found = fitting.fit("logreg", mixed)
    assert found.encoder.dictionaries and agreement.check_fitted(found, mixed.df, "id", "d").first()["mismatch_count"] == 0


def test_library_model_by_parts(spark, frame, monkeypatch):
    """Parts of the wide column predict what one model does, with a mode, unseen values and rows without a value."""
    frame = AuditFrame(frame.df, "y", "s", ("x",), ("city", "s"), row_id="id")
    encoder = fit_encoder(frame, inline=10)
    new = frame.df.unionByName(spark.createDataFrame([(9000, 1.0, "unseen", None, "p", 1), (9001, None, None, None, "zz", 0)], frame.df.schema))
    one = fitting.fit("logreg", frame, encoder=encoder)
    monkeypatch.setattr(fitting, "PART", 7)
    monkeypatch.setattr(fitting, "PART_ROWS", 100)
    parts = fitting.fit("logreg", frame, encoder=encoder)
    assert isinstance(parts.model, fitting.ModelParts) and parts.model.parts == 6
    whole = one.model.coefficients.toArray()
    for k in range(6):
        own = parts.model.part(k).coefficients.toArray()
        assert own.tolist() == pytest.approx([whole[0], *whole[1 + 7 * k : 1 + min(7 * k + 7, 40)], *whole[41:]], abs=1e-10)
    got = [rows_of(m.library_predictions(new, ["id"]), "id") for m in (one, parts)]
    assert len(got[0]) == 502 and got[0] == got[1]
    assert parts.library_predictions(new.limit(0), ["id"]).count() == 0


def test_roots_of_runs_far_from_their_start():
    z, sizes, ones = [-40.0] * 5000 + [30.0] * 4 + [0.0], [5000, 4, 1], [5000, 0, 1]
    u = profiled.roots(np.array(z), np.array(sizes), np.array(ones, float))
    at = np.cumsum([0, *sizes])
    for a, b, n, v in zip(at, at[1:], ones, u, strict=False):
        assert abs(profiled.squash(np.array(z[a:b]) + v).sum() - n + v) < 1e-8
