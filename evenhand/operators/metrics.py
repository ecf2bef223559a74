"""Quality and group metrics.

All of them start from one table of counts per outcome (:func:`prediction_counts`), which is one
partially aggregated job over the rows; everything after it works on a few lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.frame import AuditFrame
from evenhand.functions.expressions import as_group
from evenhand.functions.groups import swapped
from evenhand.operators.scorers import count_models

MODEL_KEYS = ["model", "include_sensitive"]


def group_table(df: DataFrame, sensitive: str) -> DataFrame:
    """Distinct non-null groups, one per line: ``(g)``."""
    return df.select(F.col(sensitive).cast("string").alias("g")).filter("g is not null").distinct()


def groups_array(df: DataFrame, sensitive: str) -> DataFrame:
    """Sorted distinct non-null groups as one array."""
    return group_table(df, sensitive).agg(F.array_sort(F.collect_list("g")).alias("groups"))


def resolve_groups(frame: AuditFrame, groups: list[str] | None = None) -> list[str]:
    """The given groups, or the distinct values of the sensitive column, sorted.

    They come to the driver, because a row is scored in every one of them: a probe of a column with very many values
    costs that many scorings a row, and its pair check has a line per pair.
    """
    if groups is not None:
        return list(groups)
    return sorted(r["g"] for r in group_table(frame.df, frame.sensitive).collect())


def prediction_counts(frame: AuditFrame, scorers: list) -> DataFrame:
    """``(label, grp, model, include_sensitive, pred, n)``: rows per outcome, for all models in one scan."""
    df = frame.df.withColumns({"_label": F.col(frame.label), "_grp": F.col(frame.sensitive).cast("string")})
    counts = count_models(df, ["_label", "_grp"], [(s, {"pred": s().pred_text}) for s in scorers])
    return counts.withColumnsRenamed({"_label": "label", "_grp": "grp"})


def count_cells(counts: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts of class 1 per key."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    def cell(label: int, pred: int) -> Column:
        return total((F.col("label") == label) & (F.col("pred") == pred))

    return counts.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        total(F.col("pred") == 1).alias("n_pos"),
        cell(1, 1).alias("tp"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(0, 0).alias("tn"),
    )


def accuracy_of(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return F.try_divide((tp + tn).cast("double"), (tp + fp + fn + tn).cast("double"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of class 1; 0 when nothing is positive on either side."""
    return F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))


def quality(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy and F1 per model."""
    keys = by or MODEL_KEYS
    c = count_cells(counts, keys)
    return c.select(
        *keys,
        accuracy_of(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("accuracy"),
        f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
        F.col("n_rows").alias("test_size"),
    )


def classification_report(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    keys = by or MODEL_KEYS
    c = count_cells(counts, keys)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def entry(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            p.cast("double").alias("precision"),
            r.cast("double").alias("recall"),
            f.cast("double").alias("f1"),
            support.cast("bigint").alias("support"),
        )

    wide = c.select(
        *keys,
        ratio(tn, tn + fn).alias("p0"),
        ratio(tn, tn + fp).alias("r0"),
        f1_of(tn, fn, fp).alias("f0"),
        (tn + fp).alias("s0"),
        ratio(tp, tp + fp).alias("p1"),
        ratio(tp, tp + fn).alias("r1"),
        f1_of(tp, fp, fn).alias("f1"),
        (tp + fn).alias("s1"),
        accuracy_of(tp, fp, fn, tn).alias("acc"),
    )
    p0, r0, f0, s0, p1, r1, f1, s1, acc = (F.col(x) for x in ("p0", "r0", "f0", "s0", "p1", "r1", "f1", "s1", "acc"))

    def weighted(a: Column, b: Column) -> Column:
        return ratio(a * s0 + b * s1, s0 + s1)

    total = s0 + s1
    return wide.select(
        *keys,
        F.inline(
            F.array(
                entry("0", p0, r0, f0, s0),
                entry("1", p1, r1, f1, s1),
                entry("accuracy", acc, acc, acc, total),
                entry("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
                entry("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
            )
        ),
    )


def group_rates(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Positive rate per sensitive group; rows without a group are left out."""
    keys = by or MODEL_KEYS
    cells = count_cells(counts.filter("grp is not null"), [*keys, "grp"])
    rate = F.col("n_pos").cast("double") / F.col("n_rows")
    return cells.select(*keys, "grp", rate.alias("positive_rate"), "n_rows")


def parity_gap(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Largest minus smallest group rate, and the rates as a map in group order."""
    keys = by or MODEL_KEYS
    return rates.groupBy(*keys).agg(
        (F.max("positive_rate") - F.min("positive_rate")).alias("dp_gap"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "positive_rate")))).alias("dp_rates"),
    )


def binary_flip_rate(frame: AuditFrame, scorers: list) -> DataFrame:
    """Swap the two groups everywhere and count changed predictions.

    NULL unless the sensitive column has exactly two groups; NULL and other values stay as they are
    but count in the denominator.
    """
    groups = groups_array(frame.df, frame.sensitive).scalar()
    s = F.col(frame.sensitive).cast("string")
    df = frame.df.withColumn("_other", swapped(s, F.get(groups, F.lit(0)), F.get(groups, F.lit(1))))
    changed = as_group(frame.sensitive, "_other")
    flips = [(m, {"flip": f"CAST({m().pred_text} <> {m(changed).pred_text} AS INT)"}) for m in scorers]
    sums = count_models(df, [], flips).groupBy("model").agg(
        F.sum(F.col("flip") * F.col("n")).alias("flips"), F.sum("n").alias("n_rows")
    )
    two = F.size(groups) == 2
    return sums.select(
        "model",
        F.when(two, F.col("flips")).alias("cf_flips"),
        F.when(two, F.try_divide(F.col("flips").cast("double"), F.col("n_rows").cast("double"))).alias("cf_flip_rate"),
    )


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n_rows"))


def experiment_summary(frame: AuditFrame, scorers: list, dataset: str) -> DataFrame:
    """One row per (model, mode): accuracy, F1, parity gap, group rates and size.

    A single scan scores every model in both modes; the only shuffle of that scan carries one line
    per outcome, group and task. The gap of a blind model is NULL.
    """
    cells = count_cells(prediction_counts(frame, scorers), [*MODEL_KEYS, "grp"])
    rate = F.col("n_pos").cast("double") / F.col("n_rows")
    shown = F.col("include_sensitive") & F.col("grp").isNotNull()
    per_model = cells.withColumn("rate", F.when(shown, rate)).groupBy(*MODEL_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "tp", "fp", "fn", "tn")],
        (F.max("rate") - F.min("rate")).alias("dp_gap"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(shown, F.struct(F.col("grp"), F.col("rate")))))
        ).alias("dp_rates"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return per_model.select(
        F.lit(dataset).alias("dataset"),
        *MODEL_KEYS,
        F.lit(frame.sensitive).alias("sensitive_attribute"),
        accuracy_of(tp, fp, fn, tn).alias("accuracy"),
        f1_of(tp, fp, fn).alias("f1"),
        "dp_gap",
        "dp_rates",
        F.col("n_rows").alias("test_size"),
    )
