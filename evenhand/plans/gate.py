"""The PASS / FAIL / WARNING gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.text import category_rank
from evenhand.plans.reports import DATASET_ORDER, SOLVER_MODEL_ORDER, agreement_totals

EXIT_CODES = {"PASS": 0, "FAIL": 1, "WARNING": 2}


def _counts(summary: DataFrame) -> DataFrame:
    """Anything that is neither PASS nor FAIL counts as WARNING, a missing status included."""
    s = F.coalesce(F.upper("ci_status"), F.lit("WARNING"))
    return summary.agg(
        F.count_if(s == "PASS").alias("n_pass"),
        F.count_if(s == "FAIL").alias("n_fail"),
        F.count_if(~s.isin("PASS", "FAIL")).alias("n_warning"),
        F.count("*").alias("n_total"),
    )


def expect(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """The summary, and a WARNING line for every expected ``(dataset, model)`` without a result.

    Results that nobody expected stay. Names are compared as they are, so display names go with display names.
    """
    names = expected.select("dataset", "model").distinct()
    missing = names.join(summary.select("dataset", "model"), ["dataset", "model"], "left_anti")
    return summary.unionByName(missing.withColumn("ci_status", F.lit("WARNING")), allowMissingColumns=True)


def _verdict():
    return (
        F.when(F.col("n_fail") > 0, "FAIL")
        .when((F.col("n_warning") > 0) | (F.col("n_total") == 0), "WARNING")
        .otherwise("PASS")
    )


def _exit_code(status):
    return F.when(status == "FAIL", EXIT_CODES["FAIL"]).when(status == "WARNING", EXIT_CODES["WARNING"]).otherwise(
        EXIT_CODES["PASS"]
    )


def gate(summary: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """FAIL if any model fails (code 1), else WARNING if any is inconclusive, an expected one has no
    result, or nothing was checked (code 2), else PASS (code 0)."""
    summary = summary if expected is None else expect(summary, expected)
    status = _verdict()
    return _counts(summary).select(
        status.alias("overall_status"), _exit_code(status).alias("exit_code"), "n_pass", "n_fail", "n_warning", "n_total"
    )


def gate_lists(
    summary: DataFrame, dataset_order: list[str] | None = None, model_order: list[str] | None = None
) -> DataFrame:
    """``dataset / model`` texts per status, in report order; names outside the orders come last."""
    s = F.coalesce(F.upper("ci_status"), F.lit("WARNING"))
    kind = F.when(s.isin("PASS", "FAIL"), s).otherwise("WARNING")
    datasets, models = dataset_order or DATASET_ORDER, model_order or SOLVER_MODEL_ORDER
    entry = F.struct(
        F.coalesce(category_rank(F.col("dataset"), datasets), F.lit(len(datasets) + 1).cast("bigint")).alias("d"),
        F.coalesce(category_rank(F.col("model"), models), F.lit(len(models) + 1).cast("bigint")).alias("m"),
        F.concat("dataset", F.lit(" / "), "model").alias("_text"),
    )

    def listed(status: str):
        return F.transform(F.array_sort(F.collect_list(F.when(kind == status, entry))), lambda e: e["_text"])

    return summary.agg(
        listed("FAIL").alias("failed_models"),
        listed("WARNING").alias("warning_models"),
        listed("PASS").alias("passed_models"),
    )


def agreement_block(rows: DataFrame) -> DataFrame:
    """Totals of the agreement check with its own PASS / FAIL; it does not decide the gate."""
    return agreement_totals(rows).withColumn("status", F.when(F.col("mismatch") == 0, "PASS").otherwise("FAIL"))


def gate_document(
    summary: DataFrame,
    agreement: DataFrame | None = None,
    inputs: dict[str, str] | None = None,
    generated_at: str | None = None,
    dataset_order: list[str] | None = None,
    model_order: list[str] | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """The whole status document as one nested row. Without agreement rows that block is NULL; an
    expected ``(dataset, model)`` without a result is a WARNING."""
    summary = summary if expected is None else expect(summary, expected)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stamp = F.lit(generated_at) if generated_at else now
    head = gate(summary).select(F.struct("*")).scalar()
    lists = gate_lists(summary, dataset_order, model_order).select(F.struct("*")).scalar()
    block_type = "struct<rows:bigint,samples:bigint,mismatch:bigint,match_rate:double,status:string>"
    block = F.lit(None) if agreement is None else agreement_block(agreement).select(F.struct("*")).scalar()
    given = [F.lit(v).alias(k) for k, v in (inputs or {}).items()]
    one = summary.sparkSession.range(1).select(head.alias("h"), lists.alias("l"), block.cast(block_type).alias("a"))
    return one.select(
        stamp.alias("generated_at_utc"),
        F.col("h.overall_status").alias("overall_status"),
        F.col("h.exit_code").alias("exit_code"),
        F.struct(
            F.col("h.n_pass").alias("pass"),
            F.col("h.n_fail").alias("fail"),
            F.col("h.n_warning").alias("warning"),
            F.col("h.n_total").alias("total"),
        ).alias("counts"),
        "l.failed_models",
        "l.warning_models",
        "l.passed_models",
        F.col("a").alias("encoder_validation"),
        *([F.struct(*given).alias("inputs")] if given else []),
    )


def result_table(summary: DataFrame) -> DataFrame:
    """Per-model lines of the gate report."""
    return summary.select(
        "dataset", "model", "sensitive_attribute", "solver_status", "ci_status", "checked_pairs",
        "has_counterexample", "first_counterexample_pair",
    )
