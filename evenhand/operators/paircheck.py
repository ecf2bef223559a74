"""Pairwise violation check over the observed rows.

For an ordered pair of groups (source, target) and a model: is there a row whose prediction differs
when its sensitive value is pinned to the one and to the other, all else equal?
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.frame import AuditFrame
from evenhand.functions.expressions import Lookup, as_group, plain
from evenhand.operators.features import Encoder
from evenhand.operators.metrics import group_table, resolve_groups
from evenhand.operators.probes import BITS, _array, has_pattern, mask_columns, response_counts
from evenhand.operators.scorers import of_model, with_tables
from evenhand.session import settle

# Fixed value: the text of the checked property, as readers of the documents expect it.
PROPERTY = (
    "existence of two inputs equal on all non-sensitive transformed features, "
    "different on {}, with different model predictions"
)
# Reported next to the status for compatibility; the bound does not limit anything.
CE_BOUND = 100
PAIR_PARTS = 16


def group_pairs(df: DataFrame, sensitive: str) -> DataFrame:
    """Ordered pairs of distinct groups."""
    return _pairs_of(group_table(df, sensitive))


def _pairs_of(groups: DataFrame) -> DataFrame:
    """All ordered pairs of the lines of a table of groups, dealt over several tasks by the second group."""
    sources = groups.select(F.col("g").alias("source_group"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_PARTS - 1))).alias("_part"))
    targets = groups.select(F.col("g").alias("target_group"), F.pmod(F.hash("g"), F.lit(PAIR_PARTS)).alias("_part"))
    return sources.join(targets, "_part").filter("source_group <> target_group").drop("_part")


def observed_pairs(
    frame: AuditFrame, scorers: list, groups: list[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Status of every ordered pair over all rows; every row serves as source and as target.

    The rows are folded into response patterns first. A pattern makes a line only for two groups that differ in it,
    one with a 1 and one with a 0; pairs of which no pattern tells are unviolated. Rows without a prediction in some
    group are not checked.
    """
    groups = resolve_groups(frame, groups)
    counts = response_counts(frame, scorers, groups) if counts is None else counts
    masks = mask_columns(groups)
    has_rows = "first_row" in counts.columns
    patterns = counts.filter(has_pattern(groups)).groupBy("model", *masks).agg(
        F.sum("n").alias("n"), *([F.min("first_row").alias("first_row")] if has_rows else [])
    )
    if len(groups) > 1:
        patterns = settle(patterns)
    listed = f"array({', '.join(masks)})"
    bit = f"shiftright({listed}[i div {BITS}], CAST(i % {BITS} AS INT)) & 1L"
    members = f"filter(sequence(0, {len(groups) - 1}), i -> {bit} = {{}})" if groups else "CAST(array() AS ARRAY<INT>) -- {}"
    kept = ["model", "n", *(["first_row"] if has_rows else [])]
    names = _array(groups)
    differing = (
        patterns.select(*kept, F.expr(members.format("1L")).alias("ones"), F.expr(members.format("0L")).alias("zeros"))
        .filter((F.size("ones") > 0) & (F.size("zeros") > 0))
        .select(*kept, F.explode("ones").alias("a"), "zeros")
        .select(*kept, "a", F.explode("zeros").alias("b"))
        .groupBy("model", "a", "b")
        .agg(F.sum("n").alias("n"), *([F.min("first_row").alias("first_row")] if has_rows else []))
    )
    both = F.inline(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))
    violations = (
        differing.select(*kept, both)
        .groupBy("model", F.get(names, F.col("i")).alias("source_group"), F.get(names, F.col("j")).alias("target_group"))
        .agg(F.sum("n").alias("violations"), *([F.min("first_row").alias("first_row")] if has_rows else []))
    )
    spark = frame.df.sparkSession
    rows = patterns.groupBy("model").agg(F.sum("n").alias("rows_checked"))
    every = _pairs_of(spark.createDataFrame([(g,) for g in groups], "g string"))
    every = every.withColumn("model", F.explode(F.array(*[F.lit(s.name) for s in scorers])))
    key = ["model", "source_group", "target_group"]
    return (
        every.join(violations, key, "left")
        .join(rows, "model")
        .select(
            *key,
            F.when(F.col("violations") > 0, "sat").otherwise("unsat").alias("status"),
            "rows_checked",
            F.coalesce("violations", F.lit(0)).alias("violations"),
            *(["first_row"] if has_rows else []),
        )
    )


def overall_status(pairs: DataFrame, by: list[str] | None = None, models: DataFrame | None = None) -> DataFrame:
    """SAT if any pair is, else UNKNOWN if any pair is undecided, else UNSAT; with pair counts.

    ``models``, a table of the keys, gives a model without any pair a row as well: it has nothing to violate.
    """
    keys = by or ["model"]
    sat = F.count_if(F.col("status") == "sat")
    unsat = F.count_if(F.col("status") == "unsat")
    total = F.count("status")
    if models is not None:
        pairs = models.select(*keys).join(pairs, keys, "left")
    return pairs.groupBy(*keys).agg(
        F.when(sat > 0, "SAT").when(unsat < total, "UNKNOWN").otherwise("UNSAT").alias("overall_status"),
        total.alias("checked_pairs"),
        sat.alias("ce_found"),
    )


def first_pairs(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first violated pair per model, in (source, target) order."""
    keys = by or ["model"]
    kept = [c for c in pairs.columns if c not in keys]
    ordered = F.struct("source_group", "target_group", *[c for c in kept if c not in ("source_group", "target_group")])
    return (
        pairs.filter(F.col("status") == "sat").groupBy(*keys).agg(F.min(ordered).alias("p")).select(*keys, "p.*")
    )


def example_map(frame: AuditFrame, lookup: Lookup = plain) -> Column:
    """The row's features as ``map<string,string>``."""
    numeric, categorical = frame.features()
    pairs = []
    for c in [*numeric, *categorical]:
        pairs += [F.lit(c), F.expr(lookup(c)).cast("string")]
    return F.create_map(*pairs)


def first_counterexample(frame: AuditFrame, scorers: list, pairs: DataFrame) -> DataFrame:
    """First violated pair per model with scores, predictions and both examples.

    The witness row is found by its id: one row per model is broadcast and the frame scanned once.
    """
    row_id = frame.needs_row_id("a counterexample")
    wanted = first_pairs(pairs).select("model", "source_group", "target_group", "first_row")
    rows = frame.df.join(F.broadcast(wanted), F.col(row_id) == F.col("first_row"))  # ≤ one row per model
    rows = with_tables(rows, scorers)
    x = as_group(frame.sensitive, "source_group")
    y = as_group(frame.sensitive, "target_group")
    return rows.select(
        "model",
        "source_group",
        "target_group",
        F.col("first_row").alias("row_id"),
        of_model(scorers, lambda m: m(x).score_text).alias("score_x"),
        of_model(scorers, lambda m: m(y).score_text).alias("score_y"),
        of_model(scorers, lambda m: m(x).pred_text).alias("prediction_x"),
        of_model(scorers, lambda m: m(y).pred_text).alias("prediction_y"),
        example_map(frame, x).alias("example_x"),
        example_map(frame, y).alias("example_y"),
    )


def block_violations(df: DataFrame, encoder: Encoder) -> DataFrame:
    """One-hot check of a transformed table: per block, rows that are not 0/1 or not exactly one 1. A dictionary
    column has one slot or none."""
    parts = []
    for b in encoder.dictionaries:
        none, missing = F.lit(0).cast("bigint"), F.col(b.slot_column).isNull().cast("bigint")
        parts.append(
            F.struct(F.lit(b.source).alias("source_col"), none.alias("bad_value"), missing.alias("none_set"), none.alias("several_set"))
        )
    for b in encoder.inline().blocks:
        cols = [F.col(f"`{n}`") for n in b.names()]
        total = sum(cols[1:], cols[0])
        binary = F.lit(True)
        for c in cols:
            binary = binary & c.isin(0.0, 1.0)
        parts.append(
            F.struct(
                F.lit(b.source).alias("source_col"),
                (~binary).cast("bigint").alias("bad_value"),
                (total == 0).cast("bigint").alias("none_set"),
                (total > 1).cast("bigint").alias("several_set"),
            )
        )
    return (
        df.select(F.inline(F.array(*parts)))
        .groupBy("source_col")
        .agg(
            F.count("*").alias("n_rows"),
            F.sum("bad_value").alias("bad_value"),
            F.sum("none_set").alias("none_set"),
            F.sum("several_set").alias("several_set"),
        )
    )


def pair_documents(
    pairs: DataFrame,
    examples: DataFrame,
    dataset: str,
    sensitive: str,
    metadata: DataFrame | None = None,
    scope: str | dict[str, str] = "observed rows",
) -> DataFrame:
    """One nested row per model: overall status, all pairs in order, the first counterexample.

    Only the first violated pair carries its example. ``metadata`` may add columns per model; ``scope`` is one text
    or one per model.
    """
    if isinstance(scope, dict):
        said = F.create_map(*[F.lit(x) for pair in scope.items() for x in pair])[F.col("model")]
    else:
        said = F.lit(scope)
    key = ["model", "source_group", "target_group"]
    details = examples.select(
        *key,
        F.col("score_x").cast("string").alias("score_x"),
        F.col("score_y").cast("string").alias("score_y"),
        "prediction_x",
        "prediction_y",
        "example_x",
        "example_y",
    )
    fields = ["source_group", "target_group", "status", "score_x", "score_y", "prediction_x", "prediction_y"]
    entry = F.struct(*fields, "example_x", "example_y")
    grouped = (
        pairs.join(details, key, "left")  # details hold at most one pair per model
        .groupBy("model")
        .agg(
            F.array_sort(F.collect_list(F.struct(*fields))).alias("listed"),
            F.first(F.when(F.col("prediction_x").isNotNull(), entry), ignorenulls=True).alias("candidate"),
        )
        .withColumn("pair_checks", F.transform("listed", _with_examples))
    )
    every = None if metadata is None else metadata.select("model")
    nothing = F.array().cast(grouped.schema["pair_checks"].dataType)
    doc = overall_status(pairs, models=every).join(grouped, "model", "left").withColumn("pair_checks", F.coalesce("pair_checks", nothing)).select(
        F.lit(dataset).alias("dataset"),
        "model",
        F.lit(sensitive).alias("sensitive_attribute"),
        said.alias("encoding_scope"),
        F.lit(PROPERTY.format(sensitive)).alias("fairness_property"),
        "overall_status",
        "pair_checks",
        F.col("candidate").alias("first_counterexample"),
        F.lit(False).alias("timeout"),
        F.lit(CE_BOUND).cast("bigint").alias("ce_bound"),
        "ce_found",
    )
    return doc if metadata is None else doc.join(metadata, "model", "left")


def _with_examples(pair: Column) -> Column:
    first = F.col("candidate")
    here = (pair["source_group"] == first["source_group"]) & (pair["target_group"] == first["target_group"])
    return pair.withField("example_x", F.when(here, first["example_x"])).withField(
        "example_y", F.when(here, first["example_y"])
    )


__all__ = [
    "block_violations", "example_map", "first_counterexample", "first_pairs", "group_pairs",
    "observed_pairs", "overall_status", "pair_documents",
]
