"""Counterfactual probes: change only the sensitive value and compare predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.frame import AuditFrame
from evenhand.functions.expressions import as_group, literal
from evenhand.functions.groups import alternatives
from evenhand.operators.metrics import MODEL_KEYS, accuracy_of, f1_of, resolve_groups
from evenhand.operators.ranks import dense_index
from evenhand.operators.scorers import count_models, of_model, table_columns, with_tables

BITS = 62
#: Groups up to which a row's prediction in each of them is an expression of its own; beyond, one for all. Same bits.
INLINE_GROUPS = 2 * BITS
BROADCAST_DRAWS = 1_000_000
DISTANCE_BUCKETS = 4096
#: Parts in which the nearest rows are ranked before the last ranking.
RANK_PARTS = 32


def check_sensitive(frame: AuditFrame, scorers: list, allow_blind: bool = False) -> None:
    """A probe needs models that take the sensitive column as an input."""
    blind = [s.name for s in scorers if not s.include_sensitive]
    if blind and not allow_blind:
        raise ValueError(f"the sensitive column is not a feature of {blind}")


def _array_text(groups: list[str]) -> str:
    return f"CAST(array({', '.join(literal(g) for g in groups)}) AS ARRAY<STRING>)"


def _array(groups: list[str]) -> Column:
    return F.expr(_array_text(groups))


# ---------------------------------------------------------------------------------------------
# Response counts: what every row would be predicted as in every group
# ---------------------------------------------------------------------------------------------


def response_counts(frame: AuditFrame, scorers: list, groups: list[str]) -> DataFrame:
    """Rows per (model, group, label, prediction, response pattern).

    Bit i of the pattern is the prediction of the row if its sensitive value were ``groups[i]``
    (``mask_j`` holds 62 groups each). A row costs one scoring per group, not per pair, and the
    shuffle carries distinct patterns only, so neither the alternatives nor the pairs of groups are
    ever expanded over the data. The full probe and the pair check both read this table. With many groups the
    prediction is written once and applied to each of them; a row without a prediction has no pattern.
    """
    values = []
    for m in scorers:
        texts = {"pred": m().pred_text}
        together = m(as_group(frame.sensitive, "_g")).pred_text if len(groups) > INLINE_GROUPS else None
        for j, name in enumerate(mask_columns(groups)):
            part = groups[j * BITS : (j + 1) * BITS]
            if together is not None:
                shifted = f"transform({_array_text(part)}, (_g, _i) -> shiftleft(CAST({together} AS BIGINT), _i))"
                texts[name] = f"aggregate({shifted}, 0L, (_a, _b) -> _a + _b)"
                continue
            bits = [f"{1 << i}L * {m(as_group(frame.sensitive, literal(g))).pred_text}" for i, g in enumerate(part)]
            texts[name] = f"({' + '.join(bits) or '0L'})"
        values.append((m, texts))
    renamed = {"_label": F.col(frame.label), "_grp": F.col(frame.sensitive).cast("string")}
    if frame.row_id:
        renamed["_row"] = F.col(frame.row_id)
    counts = count_models(
        frame.df.withColumns(renamed), ["_label", "_grp"], values, "_row" if frame.row_id else None
    )
    return counts.withColumnsRenamed({"_label": "label", "_grp": "grp"})


def mask_columns(groups: list[str]) -> list[str]:
    return [f"mask_{j}" for j in range((max(len(groups), 1) + BITS - 1) // BITS)]


def bit_of(position: Column, groups: list[str]) -> Column:
    """Prediction (0/1) at a 0-based group position of the pattern."""
    out = None
    for j, name in enumerate(mask_columns(groups)):
        bit = F.call_function("shiftright", F.col(name), (position - F.lit(j * BITS)).cast("int")).bitwiseAND(F.lit(1))
        here = position.between(F.lit(j * BITS), F.lit(j * BITS + BITS - 1))
        out = F.when(here, bit) if out is None else out.when(here, bit)
    return out


def has_pattern(groups: list[str]) -> Column:
    """Whether a line of the response counts has a prediction in every group."""
    out = F.lit(True)
    for name in mask_columns(groups):
        out = out & F.col(name).isNotNull()
    return out


def full_probe_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Full-probe totals and quality per model, from the response counts.

    Rows without a prediction, their own or in some group, are no checks.
    """
    ones = F.lit(0).cast("bigint")
    for name in mask_columns(groups):
        ones = ones + F.bit_count(F.col(name))
    position = F.array_position(_array(groups), F.col("grp")) - 1
    known = F.coalesce(position >= 0, F.lit(False))
    own = F.when(known, bit_of(position, groups)).otherwise(F.lit(0))
    checked = F.col("pred").isNotNull() & has_pattern(groups)
    checks = F.when(checked, F.lit(len(groups)) - known.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    ones_elsewhere = ones - own
    flips = F.when(checked, F.when(F.col("pred") == 1, checks - ones_elsewhere).otherwise(ones_elsewhere)).otherwise(F.lit(0).cast("bigint"))
    n, label, pred = F.col("n"), F.col("label"), F.col("pred")

    def cell(y: int, p: int) -> Column:
        return F.coalesce(F.sum(F.when((label == y) & (pred == p), n)), F.lit(0))

    totals = counts.groupBy(*MODEL_KEYS).agg(
        F.sum(n * checks).alias("total_checks"),
        F.sum(n * flips).alias("flip_count"),
        F.sum(n).alias("test_size"),
        cell(1, 1).alias("tp"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(0, 0).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return totals.select(
        *MODEL_KEYS,
        "total_checks",
        "flip_count",
        flip_rate().alias("flip_rate"),
        accuracy_of(tp, fp, fn, tn).alias("accuracy"),
        f1_of(tp, fp, fn).alias("f1"),
        "test_size",
    )


def flip_rate() -> Column:
    return F.coalesce(
        F.try_divide(F.col("flip_count").cast("double"), F.col("total_checks").cast("double")), F.lit(0.0)
    )


# ---------------------------------------------------------------------------------------------
# Probe details
# ---------------------------------------------------------------------------------------------


def full_probe(frame: AuditFrame, scorers: list, groups: list[str] | None = None, allow_blind: bool = False) -> DataFrame:
    """Every row × every alternative group × every model. Map-only."""
    check_sensitive(frame, scorers, allow_blind)
    row_id = frame.needs_row_id("the full probe")
    groups = resolve_groups(frame, groups)
    s = F.col(frame.sensitive).cast("string")
    rows = frame.df.withColumn("_alt", F.explode(alternatives(_array(groups), s)))
    return _compare(rows, frame, scorers, F.col(row_id))


def _compare(rows: DataFrame, frame: AuditFrame, scorers: list, row_index: Column) -> DataFrame:
    rows = with_tables(rows, scorers)
    changed = as_group(frame.sensitive, "_alt")
    parts = ", ".join(
        f"named_struct('model', {literal(m.name)}, 'pred_orig', {m().pred_text}, 'pred_cf', {m(changed).pred_text})"
        for m in scorers
    )
    return rows.select(
        row_index.alias("row_index"),
        F.col(frame.sensitive).cast("string").alias("orig_group"),
        F.col("_alt").alias("alt_group"),
        F.expr(f"inline(array({parts}))"),
    ).select(
        "model", "row_index", "orig_group", "alt_group", "pred_orig", "pred_cf",
        (F.col("pred_orig") != F.col("pred_cf")).cast("int").alias("flipped"),
    )


def draw_hash(seed: int, key: Column) -> Column:
    """60 bits of ``md5("seed:key")``, enough to reach every row of a very large table."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def random_probe(
    frame: AuditFrame,
    scorers: list,
    draws: int,
    seed: int = 42,
    groups: list[str] | None = None,
    allow_blind: bool = False,
) -> DataFrame:
    """min(draws, rows) draws with replacement, one random alternative each.

    The draws decide which rows are needed before the data is touched: they are joined to the dense
    row number, so the rows are scanned once and never sorted. A draw whose row has no alternative
    is dropped.
    """
    check_sensitive(frame, scorers, allow_blind)
    groups = resolve_groups(frame, groups)
    row_id = frame.needs_row_id("the random probe")
    facts = [F.count("*").alias("n")]
    if frame.dense:
        facts += [F.min(row_id).alias("lo"), F.max(row_id).alias("hi")]
    seen = frame.df.agg(*facts).first()
    n_rows = seen["n"]
    # a frame that claims ids 0…n−1 and has others would lose draws; it is numbered instead
    dense = frame.dense and (seen["lo"], seen["hi"]) == (0, n_rows - 1)
    spark = frame.df.sparkSession
    picks = spark.range(min(draws, n_rows)).select(
        F.col("id").alias("draw"), (draw_hash(seed, F.col("id")) % F.lit(max(n_rows, 1))).alias("_pick")
    )
    small = F.broadcast if draws <= BROADCAST_DRAWS else (lambda df: df)  # two longs per draw
    if dense:
        chosen = picks.withColumnRenamed("_pick", "_drawn")
    else:
        # only the ids are numbered; the rows themselves are fetched by id
        numbered = dense_index(frame.df.select(F.col(row_id).alias("_drawn")), ["_drawn"])
        chosen = numbered.join(small(picks), F.col("row_index") == F.col("_pick")).select("draw", "_drawn")
    s = F.col(frame.sensitive).cast("string")
    options = alternatives(_array(groups), s)
    which = draw_hash(seed + 1, F.col("draw")) % F.nullif(F.size(options), F.lit(0))
    rows = (
        frame.df.join(small(chosen), F.col(row_id) == F.col("_drawn"))
        .withColumn("_alt", F.get(options, which.cast("int")))
        .filter("_alt is not null")
    )
    return _compare(rows, frame, scorers, F.col(row_id))


def boundary_distance(proba: Column) -> Column:
    return F.abs(proba - F.lit(0.5))


def nearest_rows(frame: AuditFrame, scorers: list, k: int) -> DataFrame:
    """Per model the min(k, rows) rows nearest the decision boundary, ties by row id.

    Two scans, however many models: the first counts the distances of all models in buckets, which bounds how far the
    k nearest rows can lie (at most 4,096 lines a model come back); the second keeps what lies within the bound. Only
    that is ranked, in parts first, so the last ranking sees ``RANK_PARTS`` times k rows a model at most, also where
    many rows share one distance. A row without a probability has no distance.
    """
    row_id = frame.needs_row_id("the boundary probe")
    kept = [*frame.roles(), *table_columns(scorers)]
    base = with_tables(frame.df, scorers).select(*kept)
    bucket = f"CAST(least(floor(_d * {2 * DISTANCE_BUCKETS}), {DISTANCE_BUCKETS - 1}) AS INT)"
    distances = ", ".join(f"abs({m().proba_text} - 0.5D)" for m in scorers)
    numbered = f"transform(array({distances}), (_d, _m) -> named_struct('_m', _m, '_distance', _d, '_bucket', {bucket}))"
    seen = base.select(F.expr(f"inline({numbered})")).filter("_bucket is not null").groupBy("_m", "_bucket").agg(F.count("*").alias("n"))
    counts: dict[int, dict[int, int]] = {}
    for r in seen.collect():
        counts.setdefault(r["_m"], {})[r["_bucket"]] = r["n"]
    bounds = []
    for i in range(len(scorers)):
        own, total, bound = counts.get(i, {}), 0, -1
        for at in sorted(own):
            if total >= k:
                break
            total, bound = total + own[at], at
        bounds.append(bound)
    within = f"filter({numbered}, _x -> _x._bucket <= array({', '.join(map(str, bounds))})[_x._m])"
    names = F.expr(f"array({', '.join(literal(m.name) for m in scorers)})")
    near = base.select(*kept, F.expr(f"inline({within})"))
    order = ["_distance", row_id]
    parted = near.withColumn("_part", F.pmod(F.xxhash64(row_id), F.lit(RANK_PARTS)))
    first = F.row_number().over(Window.partitionBy("_m", "_part").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("_m").orderBy(*order))
    ranked = parted.withColumn("_rank", first).filter(F.col("_rank") <= k).withColumn("_rank", last).filter(F.col("_rank") <= k)
    return ranked.select(*kept, names[F.col("_m")].alias("model"), "_distance")


def boundary_probe(
    frame: AuditFrame,
    scorers: list,
    k: int,
    groups: list[str] | None = None,
    allow_blind: bool = False,
) -> DataFrame:
    """The rows nearest the boundary × every alternative, with both probabilities."""
    check_sensitive(frame, scorers, allow_blind)
    groups = resolve_groups(frame, groups)
    s = F.col(frame.sensitive).cast("string")
    rows = nearest_rows(frame, scorers, k).withColumn("_alt", F.explode(alternatives(_array(groups), s)))

    changed = as_group(frame.sensitive, "_alt")
    return rows.select(
        "model",
        F.col(frame.row_id).alias("row_index"),
        F.col("_distance").alias("boundary_distance"),
        s.alias("orig_group"),
        F.col("_alt").alias("alt_group"),
        of_model(scorers, lambda m: m().pred_text).alias("pred_orig"),
        of_model(scorers, lambda m: m(changed).pred_text).alias("pred_cf"),
        of_model(scorers, lambda m: m().proba_text).alias("proba_orig"),
        of_model(scorers, lambda m: m(changed).proba_text).alias("proba_cf"),
    ).withColumn("flipped", (F.col("pred_orig") != F.col("pred_cf")).cast("int"))


def probe_summary(
    details: DataFrame,
    quality: DataFrame,
    baseline: str,
    dataset: str,
    sensitive: str,
    top_k: int | None = None,
    samples: bool = False,
) -> DataFrame:
    """One row per model: checks, flips and flip rate (0.0 when nothing was checked), next to the model's quality.

    A check without a prediction on either side is none. ``top_k`` adds the number of rows a boundary probe looked at,
    min(K, rows), whether or not they had an alternative; ``samples`` adds the draws that were checked, ``n_samples``.
    """
    sums = details.groupBy("model").agg(F.count("flipped").alias("total_checks"), F.sum("flipped").alias("flip_count"))
    # one row per model on both sides
    joined = quality.join(sums, "model", "left").fillna(0, ["total_checks", "flip_count"])
    counted = []
    if top_k is not None:
        counted.append(F.least(F.lit(top_k).cast("bigint"), F.col("test_size")).alias("top_k"))
    if samples:
        counted.append(F.col("total_checks").alias("n_samples"))
    return joined.select(
        F.lit(baseline).alias("baseline"),
        F.lit(dataset).alias("dataset"),
        "model",
        F.lit(sensitive).alias("sensitive_attribute"),
        F.col("include_sensitive").alias("include_sensitive_model"),
        *counted,
        "total_checks",
        "flip_count",
        flip_rate().alias("flip_rate"),
        "accuracy",
        "f1",
        "test_size",
    )


def full_probe_summary(totals: DataFrame, dataset: str, sensitive: str) -> DataFrame:
    """Summary lines of the full probe from :func:`full_probe_counts`; no check is ever written out."""
    return totals.select(
        F.lit("counterfactual_augmentation").alias("baseline"),
        F.lit(dataset).alias("dataset"),
        "model",
        F.lit(sensitive).alias("sensitive_attribute"),
        F.col("include_sensitive").alias("include_sensitive_model"),
        "total_checks",
        "flip_count",
        "flip_rate",
        "accuracy",
        "f1",
        "test_size",
    )
