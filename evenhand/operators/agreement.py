"""Does a model and its exported expression predict the same?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.operators.scorers import with_tables

SHOWN_MISMATCHES = 10


def match_rate(samples: Column, mismatches: Column) -> Column:
    """Matching share in percent with two digits; 0.0 for no samples."""
    share = F.try_divide((samples - mismatches).cast("double") * 100.0, samples.cast("double"))
    return F.coalesce(F.round(share, 2), F.lit(0.0))


def first_rows(df: DataFrame, row_id: str, n: int | None = None) -> DataFrame:
    """All rows, or the first ``n`` by id (a top-n per task)."""
    return df if n is None else df.orderBy(row_id).limit(n)


def agreement(both: DataFrame, left: str, right: str, dataset: str, model: str) -> DataFrame:
    """``(dataset, model, samples_checked, mismatch_count, match_rate)`` of two prediction columns."""
    different = ~F.col(left).eqNullSafe(F.col(right))
    return both.agg(
        F.count("*").alias("samples_checked"), F.count_if(different).alias("mismatch_count")
    ).select(
        F.lit(dataset).alias("dataset"),
        F.lit(model).alias("model"),
        "samples_checked",
        "mismatch_count",
        match_rate(F.col("samples_checked"), F.col("mismatch_count")).alias("match_rate"),
    )


def mismatches(both: DataFrame, row_id: str, left: str, right: str, n: int = SHOWN_MISMATCHES) -> DataFrame:
    """The first ``n`` rows on which the two differ."""
    return (
        both.filter(~F.col(left).eqNullSafe(F.col(right)))
        .select(F.col(row_id).alias("row_id"), F.col(left).alias("left_pred"), F.col(right).alias("right_pred"))
        .orderBy("row_id")
        .limit(n)
    )


def check_fitted(fitted, df: DataFrame, row_id: str, dataset: str, n: int | None = None) -> DataFrame:
    """MLlib's own prediction beside the generated expression, on all rows or the first ``n``."""
    rows = with_tables(first_rows(df, row_id, n), [fitted.scorer]).withColumn("expression_pred", fitted.scorer().pred)
    both = fitted.library_predictions(rows, [row_id, "expression_pred"])
    return agreement(both, "library_pred", "expression_pred", dataset, fitted.scorer.name)
