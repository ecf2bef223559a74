"""Whole audits: experiments, probes, pair checks, agreement and gate over one frame.

Each function is one chain of DataFrames. Short intermediate tables that several steps read are
settled, so that no step computes them again. The number of passes over the data is fixed but for the
medians of large columns, which take as many as their values need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.frame import AuditFrame
from evenhand.functions import text
from evenhand.operators import agreement, boxcheck, metrics, paircheck, probes
from evenhand.operators import scorers as S
from evenhand.operators.fitting import KINDS, fit_all
from evenhand.plans import gate as gates
from evenhand.plans import reports
from evenhand.session import settle

# The texts of the scopes, as readers of the documents expect them.
BOX_SCOPES = {
    "tree": "exact tree over transformed feature space (one-hot categoricals + standardized numerics)",
    "rulelist": "exact ordered rule-list over transformed feature space (one-hot categoricals + standardized numerics)",
    "logreg": "exact linear threshold over transformed feature space (one-hot categoricals + standardized numerics)",
}


def probe_report(
    frame: AuditFrame,
    scorers: list,
    dataset: str,
    draws: int,
    nearest: int,
    seed: int = 42,
    groups: list[str] | None = None,
) -> DataFrame:
    """The three probe summaries of a frame.

    Passes over the data: one for the groups (unless given), one for the response counts, which give
    the full probe and the quality of all models, one for the random and one for the boundary probe.
    """
    probes.check_sensitive(frame, scorers)
    groups = metrics.resolve_groups(frame, groups)
    totals = settle(probes.full_probe_counts(probes.response_counts(frame, scorers, groups), groups))
    quality = totals.select("model", "include_sensitive", "accuracy", "f1", "test_size")
    common = (dataset, frame.sensitive)
    random = probes.probe_summary(
        probes.random_probe(frame, scorers, draws, seed, groups), quality, reports.PROBES[0], *common, samples=True
    )
    full = probes.full_probe_summary(totals, *common)
    near = probes.probe_summary(
        probes.boundary_probe(frame, scorers, nearest, groups), quality, reports.PROBES[2], *common, top_k=nearest
    )
    return random.unionByName(full, allowMissingColumns=True).unionByName(near, allowMissingColumns=True)


def observed_documents(
    frame: AuditFrame, scorers: list, dataset: str, groups: list[str] | None = None, rows: tuple[int, int] | None = None
) -> DataFrame:
    """Pair-check documents over the observed rows: one pass for the pairs, one for the witnesses.

    ``rows`` are the numbers of training and test rows, for the documents' own record.
    """
    pairs = settle(paircheck.observed_pairs(frame, scorers, groups))
    examples = paircheck.first_counterexample(frame, scorers, pairs)
    return paircheck.pair_documents(pairs, examples, dataset, frame.sensitive, model_facts(frame, scorers, rows))


def model_facts(frame: AuditFrame, scorers: list, rows: tuple[int, int] | None = None) -> DataFrame:
    """Number of rules (a list's default is none of them), depth, intercept and numbers of rows per model."""

    def depth(s) -> int:
        return max((len(conditions) for _, _, conditions, _, _ in s.rule_rows()), default=0)

    facts = [
        (
            s.name,
            s.kind,
            len(s.rule_rows()) - (s.kind == "rulelist") if s.kind in ("tree", "rulelist") else None,
            depth(s) if s.kind == "tree" else None,
            depth(s) if s.kind == "rulelist" else None,
            float(s.intercept) if s.kind == "logreg" else None,
            *(rows or (None, None)),
        )
        for s in scorers
    ]
    return frame.df.sparkSession.createDataFrame(
        facts,
        "model string, kind string, num_rules int, tree_max_depth int, rulelist_max_depth int, logreg_intercept double, "
        "n_train_rows bigint, n_test_rows bigint",
    )


NO_WITNESS = (
    "model string, source_group string, target_group string, score_x double, score_y double, "
    "prediction_x int, prediction_y int, example_x map<string,string>, example_y map<string,string>"
)


def _by_encoder(scorers: list) -> list[tuple]:
    """Models in groups that share an encoder and have different names, in the order they first come up."""
    groups: list[tuple] = []
    for s in scorers:
        own = next((m for e, m in groups if e == s.encoder and s.name not in [x.name for x in m]), None)
        if own is None:
            groups.append((s.encoder, [s]))
        else:
            own.append(s)
    return groups


def box_documents(frame: AuditFrame, scorers: list, dataset: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """Pair-check documents over the whole feature box of the frame.

    The bounds are one pass per encoder; the checks themselves work on the models only, all linear models of an
    encoder together. Every model has a document: one that does not see the sensitive column cannot tell the groups
    apart, and one that sees it as a number is checked at the values of the groups.
    """
    spark = frame.df.sparkSession
    parts = []
    for encoder, members in _by_encoder(scorers):
        schema = encoder.schema_table(spark)
        numeric = next((f for f in encoder.numeric if f.source == frame.sensitive), None)
        if encoder.block(frame.sensitive) is None and numeric is None:
            names = F.explode(F.array(*[F.lit(s.name) for s in members])).alias("model")
            pairs = settle(
                paircheck.group_pairs(frame.df, frame.sensitive)
                .select("source_group", "target_group", F.lit("unsat").alias("status"), names)
            )
            parts += [(members, pairs, spark.createDataFrame([], NO_WITNESS))]
            continue
        bounds = settle(encoder.bounds_table(frame.df))
        values = None if numeric is None else boxcheck.group_values(frame, numeric)
        linear = [s for s in members if s.kind == "logreg"]
        if linear:
            terms = boxcheck.linear_terms(S.weight_table(spark, linear), schema, bounds)
            if values is not None:
                terms = boxcheck.pinned_terms(terms, values, frame.sensitive)
            columns = boxcheck.categorical_columns(schema, frame.sensitive)
            stages = boxcheck.fold_intervals(terms, columns, frame.sensitive)
            pairs = settle(boxcheck.linear_box_pairs(terms, schema, frame.sensitive, stages))
            parts += [(linear, pairs, boxcheck.linear_witness(terms, schema, frame.sensitive, pairs, stages))]
        others = [s for s in members if s.kind != "logreg"]
        if others:
            regions = boxcheck.disjoint_regions(S.rule_table(spark, others))
            pairs = settle(boxcheck.region_box_pairs(regions, schema, bounds, frame.sensitive, values))
            parts += [(others, pairs, boxcheck.region_witness(regions, schema, bounds, frame.sensitive, pairs))]
    out = None
    for members, pairs, examples in parts:
        scopes = {s.name: BOX_SCOPES[s.kind] for s in members}
        part = paircheck.pair_documents(
            pairs, examples, dataset, frame.sensitive, model_facts(frame, members, rows), scopes
        )
        out = part if out is None else out.unionByName(part)
    return out


def experiment(
    train: AuditFrame, test: AuditFrame, dataset: str, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """Train every kind with and without the sensitive column and summarise the test rows."""
    scorers = [f.scorer for mode in (True, False) for f in fit_all(train, kinds, mode)]
    return metrics.experiment_summary(test, scorers, dataset)


@dataclass(frozen=True)
class Audit:
    """The tables of a finished audit."""

    experiments: DataFrame
    probes: DataFrame
    documents: DataFrame
    solver_summary: DataFrame
    counterexamples: DataFrame
    root_causes: DataFrame
    agreement: DataFrame
    gate: DataFrame


def full_audit(
    train: AuditFrame,
    test: AuditFrame,
    dataset: str,
    draws: int = 500,
    nearest: int = 500,
    kinds: tuple[str, ...] = KINDS,
    samples: int | None = None,
) -> Audit:
    """From training rows to the gate: the box check uses the bounds of the training rows."""
    fitted = fit_all(train, kinds)
    scorers = [f.scorer for f in fitted]
    blind = [f.scorer for f in fit_all(train, kinds, include_sensitive=False)]
    names = text.display_name(F.col("model"), reports.MODEL_NAMES)
    sizes = (train.df.count(), test.df.count())
    documents = settle(box_documents(train, scorers, dataset, sizes).withColumn("model", names))
    # a model without a document must not go unnoticed
    expected = train.df.sparkSession.createDataFrame([(dataset, s.name) for s in scorers], "dataset string, model string")
    expected = expected.withColumn("model", names)
    summary = reports.solver_summary(documents, [dataset])
    counterexamples = reports.counterexample_report(summary, documents)
    rows = None
    for f in fitted:
        part = agreement.check_fitted(f, test.df, test.needs_row_id("the agreement check"), dataset, samples)
        rows = part if rows is None else rows.unionByName(part)
    rows = settle(rows.withColumn("model", names))
    return Audit(
        experiments=metrics.experiment_summary(test, scorers + blind, dataset),
        probes=probe_report(test, scorers, dataset, draws, nearest),
        documents=documents,
        solver_summary=summary,
        counterexamples=counterexamples,
        root_causes=reports.root_cause_report(counterexamples),
        agreement=rows,
        gate=gates.gate_document(summary, rows, dataset_order=[dataset], expected=expected),
    )
