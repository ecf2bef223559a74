"""Cross-dataset tables, ablations and counterexample reports.

Inputs are summary tables with one row per (dataset, model, mode) or (dataset, model, probe). Joins
between them are equi-joins on those keys and left to the optimiser.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import text
from evenhand.operators.agreement import match_rate
from evenhand.operators.clean import add_if_absent, order_by_categories, score_distance

# Fixed display names, orders and texts that reports must show unchanged.
MODEL_NAMES = {"tree": "Decision Tree", "logreg": "Logistic Regression", "rulelist": "Rule List"}
DATASET_ORDER = ["scholarship", "adult", "german_credit"]
SUMMARY_MODEL_ORDER = ["Decision Tree", "Logistic Regression", "Rule List"]
SOLVER_MODEL_ORDER = ["Decision Tree", "Rule List", "Logistic Regression"]
PROBES = ["random_pair_sampling", "counterfactual_augmentation", "boundary_focused_sampling"]
INTERPRETATION = {
    "UNSAT": "PASS (no counterexample found for the encoded fairness property)",
    "SAT": "FAIL (counterexample found)",
    "OTHER": "WARNING / INCONCLUSIVE",
}
ROOT_CAUSES = [
    ("sex", "Sensitive attribute change causes decision-boundary crossing"),
    ("asal_daerah", "Sensitive region attribute change causes decision-boundary crossing"),
]
ROOT_CAUSE_OTHERWISE = "Fairness violation detected"
ACTIONS = [
    ("sex", "Remove sensitive attribute from training or apply fairness constraints"),
    ("asal_daerah", "Remove regional attribute from training or apply fairness-aware retraining"),
]
ACTION_OTHERWISE = "Investigate feature influence"


def union_tables(tables: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Stack tables by column name; tags fill columns a table lacks, other gaps become NULL."""
    parts = []
    for df, tags in tables:
        for name, value in tags.items():
            df = add_if_absent(df, name, value)
        parts.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pivot_probes(probes: DataFrame) -> DataFrame:
    """Flip rates side by side, one column per probe; the probe names are fixed, so no extra scan."""
    named = probes.withColumn("model_pretty", text.display_name(F.col("model"), MODEL_NAMES))
    return (
        named.groupBy("dataset", "model", "model_pretty", "sensitive_attribute")
        .pivot("baseline", PROBES)
        .agg(F.first("flip_rate", ignorenulls=True))
    )


def final_summary(
    experiments: DataFrame,
    probes: DataFrame,
    dataset_order: list[str] | None = None,
    model_order: list[str] | None = None,
) -> DataFrame:
    """Sensitive-mode experiments with the three flip rates, in report order."""
    named = experiments.withColumn("model_pretty", text.display_name(F.col("model"), MODEL_NAMES))
    keys = ["dataset", "model", "model_pretty", "sensitive_attribute"]
    joined = named.filter(F.col("include_sensitive")).join(pivot_probes(probes), keys, "left")
    extra = [c for c in ("train_time_sec",) if c in experiments.columns]
    out = joined.select(
        "dataset",
        F.col("model_pretty").alias("model"),
        "sensitive_attribute",
        "accuracy",
        "f1",
        "dp_gap",
        F.col("random_pair_sampling").alias("baseline_random_flip_rate"),
        F.col("counterfactual_augmentation").alias("baseline_counterfactual_flip_rate"),
        F.col("boundary_focused_sampling").alias("baseline_boundary_flip_rate"),
        "dp_rates",
        *extra,
    )
    return order_by_categories(
        out, {"dataset": dataset_order or DATASET_ORDER, "model": model_order or SUMMARY_MODEL_ORDER}
    )


def removal_ablation(experiments: DataFrame) -> DataFrame:
    """Each model with and without the sensitive column; deltas are without − with.

    One conditional aggregate instead of a self join. Models that lack one of the modes are left out.
    """
    on = F.col("include_sensitive")

    def value(column: str, flag: bool):
        return F.first(F.when(on == F.lit(flag), F.col(column)), ignorenulls=True)

    wide = experiments.groupBy("dataset", "model").agg(
        value("sensitive_attribute", True).alias("sensitive_attribute"),
        value("accuracy", True).alias("accuracy_with_sensitive"),
        value("accuracy", False).alias("accuracy_without_sensitive"),
        value("f1", True).alias("f1_with_sensitive"),
        value("f1", False).alias("f1_without_sensitive"),
        value("dp_gap", True).alias("dp_gap_with_sensitive"),
        F.count_if(on).alias("_with"),
        F.count_if(~on).alias("_without"),
    )
    return wide.filter("_with > 0 and _without > 0").select(
        "dataset",
        text.display_name(F.col("model"), MODEL_NAMES).alias("model"),
        "sensitive_attribute",
        "accuracy_with_sensitive",
        "accuracy_without_sensitive",
        (F.col("accuracy_without_sensitive") - F.col("accuracy_with_sensitive")).alias("delta_accuracy"),
        "f1_with_sensitive",
        "f1_without_sensitive",
        (F.col("f1_without_sensitive") - F.col("f1_with_sensitive")).alias("delta_f1"),
        "dp_gap_with_sensitive",
    )


def probe_ablation(probes: DataFrame) -> DataFrame:
    """The three flip rates of each model and the probe with the highest one (first of a tie)."""
    r, c, b = (F.col(p) for p in PROBES)
    strongest = (
        F.when((r >= c) & (r >= b), PROBES[0]).when(c >= b, PROBES[1]).otherwise(PROBES[2])
    )
    return pivot_probes(probes).select(
        "dataset",
        F.col("model_pretty").alias("model"),
        "sensitive_attribute",
        r.alias("random_flip_rate"),
        c.alias("counterfactual_flip_rate"),
        b.alias("boundary_flip_rate"),
        strongest.alias("strongest_baseline"),
    )


def solver_summary(
    documents: DataFrame, dataset_order: list[str] | None = None, model_order: list[str] | None = None
) -> DataFrame:
    """One row per pair-check document with its gate status and first violated pair."""
    ce = F.col("first_counterexample")
    status = F.coalesce("overall_status", F.lit("UNKNOWN"))
    optional = {
        "runtime_seconds": "double", "timeout": "boolean", "ce_bound": "bigint", "ce_found": "bigint",
        "encoding_scope": "string", "fairness_property": "string",
    }

    def opt(name: str):
        column = F.col(name) if name in documents.columns else F.lit(None)
        return column.cast(optional[name]).alias(name)

    rows = documents.select(
        "dataset",
        "model",
        "sensitive_attribute",
        opt("runtime_seconds"),
        opt("timeout"),
        opt("ce_bound"),
        opt("ce_found"),
        status.alias("solver_status"),
        text.gate_status(status).alias("ci_status"),
        F.coalesce(F.size("pair_checks"), F.lit(0)).alias("checked_pairs"),
        ce.isNotNull().alias("has_counterexample"),
        text.pair_text(ce["source_group"], ce["target_group"]).alias("first_counterexample_pair"),
        opt("encoding_scope"),
        opt("fairness_property"),
    )
    return order_by_categories(
        rows, {"dataset": dataset_order or DATASET_ORDER, "model": model_order or SOLVER_MODEL_ORDER}
    )


def interpretation_table(spark) -> DataFrame:
    return spark.createDataFrame(list(INTERPRETATION.items()), "status string, meaning string")


def _in_order(rows: DataFrame, dataset_order: list[str] | None, model_order: list[str] | None) -> list:
    """What puts lines of a document in order: the ranks of data set and model, then their names."""
    last = F.lit(1 << 30).cast("bigint")
    ranks = {"dataset": dataset_order or DATASET_ORDER, "model": model_order or SOLVER_MODEL_ORDER}
    return [F.coalesce(text.category_rank(F.col(c), o), last).alias(f"_{c}") for c, o in ranks.items()] + ["dataset", "model"]


def solver_document(
    summary: DataFrame, dataset_order: list[str] | None = None, model_order: list[str] | None = None
) -> DataFrame:
    """The solver summary as one document ``(interpretation, results)``: what a status means, and a line per model.

    A document holds a line per data set and model, not per row of data.
    """
    line = F.struct(*_in_order(summary, dataset_order, model_order), F.struct(*summary.columns).alias("line"))
    meaning = F.create_map(*[F.lit(x) for pair in INTERPRETATION.items() for x in pair])
    return summary.agg(F.array_sort(F.collect_list(line)).alias("listed")).select(
        meaning.alias("interpretation"), F.transform("listed", lambda x: x["line"]).alias("results")
    )


def counterexample_document(
    summary: DataFrame, details: DataFrame, dataset_order: list[str] | None = None, model_order: list[str] | None = None
) -> DataFrame:
    """All counterexamples as one document ``(report_type, num_counterexamples, entries)``.

    An entry has both examples and their differences as nested values; a SAT row without a document raises, as in
    :func:`counterexample_report`.
    """
    report = counterexample_report(summary, details).drop("changed_features", "changed_features_count")
    ce = F.col("first_counterexample")
    own = details.select(
        "dataset", "model", ce["source_group"].alias("source_group"), ce["target_group"].alias("target_group"),
        ce["example_x"].alias("example_x"), ce["example_y"].alias("example_y"),
        text.example_diff(ce["example_x"], ce["example_y"]).alias("changed_features"), "encoding_scope", "fairness_property",
    )
    rows = report.join(own, ["dataset", "model"])
    line = F.struct(*_in_order(rows, dataset_order, model_order), F.struct(*rows.columns).alias("line"))
    # maps have no order; the key before them decides
    by_key = F.transform(
        F.array_sort(F.collect_list(line), lambda a, b: _compare(a, b)), lambda x: x["line"]
    )
    return rows.agg(by_key.alias("entries")).select(
        F.lit("formal_counterexample_report").alias("report_type"), F.size("entries").cast("bigint").alias("num_counterexamples"), "entries"
    )


def _compare(a, b):
    out = None
    for c in ("_dataset", "_model", "dataset", "model"):
        out = F.when(a[c] < b[c], -1) if out is None else out.when(a[c] < b[c], -1)
        out = out.when(a[c] > b[c], 1)
    return out.otherwise(0)


def status_counts(summary: DataFrame) -> DataFrame:
    s = F.upper("ci_status")
    return summary.agg(
        F.count_if(s == "PASS").alias("pass"),
        F.count_if(s == "FAIL").alias("fail"),
        F.count_if(s == "WARNING").alias("warning"),
        F.count("*").alias("total"),
    )


def missing_details(summary: DataFrame, details: DataFrame) -> DataFrame:
    """SAT rows without a document; must be empty before the report is used."""
    sat = summary.filter(F.upper("solver_status") == "SAT")
    return sat.join(details.select("dataset", "model"), ["dataset", "model"], "left_anti")


def counterexample_report(summary: DataFrame, details: DataFrame) -> DataFrame:
    """SAT rows with the counterexample of their document.

    A SAT row without a document raises when the report is computed.
    """
    sat = summary.filter(F.upper("solver_status") == "SAT").select(
        "dataset", "model", "sensitive_attribute", "solver_status", "ci_status",
        F.col("first_counterexample_pair").alias("counterexample_pair"),
    )
    found = details.select("dataset", "model", F.col("first_counterexample").alias("ce"), F.lit(True).alias("_found"))
    present = F.when(F.col("_found"), F.lit(True)).otherwise(
        F.raise_error(
            F.concat(F.lit("no detail document for "), F.col("dataset"), F.lit(" / "), F.col("model"))
        ).cast("boolean")
    )
    joined = sat.join(found, ["dataset", "model"], "left").filter(present)
    diff = text.example_diff(F.col("ce.example_x"), F.col("ce.example_y"))
    return joined.withColumn("diff", diff).select(
        "dataset",
        "model",
        "sensitive_attribute",
        "solver_status",
        "ci_status",
        "counterexample_pair",
        text.normalise_prediction(F.col("ce.prediction_x")).alias("prediction_x"),
        text.normalise_prediction(F.col("ce.prediction_y")).alias("prediction_y"),
        F.col("ce.score_x").alias("score_x_raw"),
        F.col("ce.score_y").alias("score_y_raw"),
        text.parse_number(F.col("ce.score_x")).alias("score_x_float"),
        text.parse_number(F.col("ce.score_y")).alias("score_y_float"),
        F.size("diff").cast("bigint").alias("changed_features_count"),
        text.diff_text(F.col("diff")).alias("changed_features"),
    )


def root_cause_report(
    report: DataFrame,
    causes: list[tuple[str, str]] | None = None,
    actions: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Distance of the two scores, likely cause and suggested action per counterexample."""
    changed = F.coalesce("changed_features", F.lit("nan"))
    return report.select(
        "dataset",
        "model",
        "sensitive_attribute",
        "counterexample_pair",
        "prediction_x",
        "prediction_y",
        "score_x_float",
        "score_y_float",
        score_distance(F.col("score_x_float"), F.col("score_y_float")).alias("boundary_distance"),
        text.first_keyword(changed, causes or ROOT_CAUSES, ROOT_CAUSE_OTHERWISE).alias("root_cause"),
        text.first_keyword(changed, actions or ACTIONS, ACTION_OTHERWISE).alias("suggested_action"),
    )


def agreement_totals(rows: DataFrame) -> DataFrame:
    """Totals over agreement rows and the overall match rate."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("samples_checked"), F.lit(0)).cast("bigint").alias("samples"),
        F.coalesce(F.sum("mismatch_count"), F.lit(0)).cast("bigint").alias("mismatch"),
    ).select("rows", "samples", "mismatch", match_rate(F.col("samples"), F.col("mismatch")).alias("match_rate"))
