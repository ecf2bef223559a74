"""Pairwise violation check over the whole feature box.

The box is given by the data: every numeric feature anywhere between its observed minimum and
maximum, every non-sensitive categorical column exactly one of its categories. The checks are
relational: models are rows, so thousands of per-segment models are checked in one job, and only
the bounds depend on the number of data rows.

Linear models. With ``base`` the score without the sensitive term, a pair (s, d) with weights
w_s, w_d is violated iff some reachable ``base`` lies in (−max(w_s, w_d), −min(w_s, w_d)]. The
numeric features reach one closed interval; each categorical column then shifts it by one of
finitely many weights. The columns are folded in one after the other and overlapping intervals are
merged, so gaps between intervals are kept exactly.

Trees and rule lists. A pair is violated iff some input region predicted 0 for one group and some
region predicted 1 for the other can hold for the same non-sensitive input. Columns are independent,
so this is decided per source column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.session import settle

INTERCEPT = "(intercept)"
LAZY_COLUMNS = 3

# ---------------------------------------------------------------------------------------------
# Linear models
# ---------------------------------------------------------------------------------------------
# terms(model, feature, kind, source_col, category, weight, lo, hi)


def linear_terms(weights: DataFrame, schema: DataFrame, bounds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weights with their feature kind and, for numeric features, the observed bounds.

    ``weights(model, feature, weight)`` with the intercept as a feature of its own,
    ``schema(feature, kind, source_col, category)``, ``bounds(feature, lo, hi)``. ``by`` names
    further key columns of ``bounds``: a box per segment checks each model in each segment. The table
    has a line per model and feature and is settled, because every later step reads it while only
    the bounds come from the data.
    """
    extra = by or []
    described = weights.join(schema.select("feature", "kind", "source_col", "category"), "feature", "left")
    numeric = described.filter("kind = 'numeric'").join(bounds, "feature", "left")
    rest = described.filter("kind is null or kind <> 'numeric'")
    if extra:
        segments = bounds.select(*extra).distinct().withColumn("feature", F.lit(INTERCEPT))
        keyed = weights.select("model", "feature").join(segments, "feature").select("model", *extra)
        rest = rest.join(keyed, "model")
    none = F.lit(None).cast("double")
    rest = rest.withColumn("lo", none).withColumn("hi", none)
    terms = numeric.unionByName(rest)
    model = F.concat_ws("|", "model", *[F.col(c).cast("string") for c in extra]) if extra else F.col("model")
    described_terms = terms.select(
        model.alias("model"),
        "feature",
        F.coalesce("kind", F.lit("intercept")).alias("kind"),
        "source_col",
        "category",
        F.col("weight").cast("double").alias("weight"),
        "lo",
        "hi",
    )
    return settle(described_terms)


def group_values(frame, feature) -> DataFrame:
    """``(category, value)`` of a sensitive column that models see as a number: every group and its transformed value."""
    z = F.expr(feature.text()).alias("value")
    seen = frame.df.filter(F.col(frame.sensitive).isNotNull())
    return settle(seen.select(F.col(frame.sensitive).cast("string").alias("category"), z).distinct())


def pinned_terms(terms: DataFrame, values: DataFrame, sensitive: str) -> DataFrame:
    """The numeric term of the sensitive column, replaced by one fixed term per group: weight × the group's value.

    From there on a group is a group, whether models see it as a number or as a category.
    """
    own = (F.col("kind") == "numeric") & (F.col("source_col") == sensitive)
    groups = values.select(F.lit(sensitive).alias("source_col"), F.col("category").alias("_group"), "value")
    fixed = (
        terms.filter(own)
        .join(groups, "source_col")
        .select(
            "model",
            F.concat_ws("=", "feature", "_group").alias("feature"),
            F.lit("onehot").alias("kind"),
            "source_col",
            F.col("_group").alias("category"),
            (F.col("weight") * F.col("value")).alias("weight"),
            F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"),
        )
    )
    return settle(terms.filter(~F.coalesce(own, F.lit(False))).unionByName(fixed))


def _start_intervals(terms: DataFrame) -> DataFrame:
    """Reachable values of intercept plus numeric features: one interval per model.

    The terms of a model are added in feature order so that the result does not depend on how rows
    arrive. A missing weight or bound makes the model undecidable.
    """
    numeric = F.col("kind") == "numeric"
    low = F.when(numeric, F.least(F.col("weight") * F.col("lo"), F.col("weight") * F.col("hi")))
    high = F.when(numeric, F.greatest(F.col("weight") * F.col("lo"), F.col("weight") * F.col("hi")))
    # least/greatest skip NULLs, so a missing bound is tested by itself
    broken = (
        F.col("weight").isNull()
        | F.isnan("weight")
        | (numeric & (F.col("lo").isNull() | F.col("hi").isNull() | F.isnan("lo") | F.isnan("hi")))
    )
    grouped = terms.groupBy("model").agg(
        F.bool_or(broken).alias("broken"),
        F.coalesce(F.max(F.when(F.col("kind") == "intercept", F.col("weight"))), F.lit(0.0)).alias("b"),
        F.array_sort(F.collect_list(F.when(numeric, F.struct("feature", low.alias("l"), high.alias("h"))))).alias("num"),
    )
    return grouped.select(
        "model",
        "broken",
        F.aggregate("num", F.col("b"), lambda acc, t: acc + t["l"]).alias("lo"),
        F.aggregate("num", F.col("b"), lambda acc, t: acc + t["h"]).alias("hi"),
    )


def categorical_columns(schema: DataFrame, sensitive: str) -> list[str]:
    """Non-sensitive one-hot columns in feature order (one row per column comes back)."""
    rows = schema.filter("kind = 'onehot'").groupBy("source_col").agg(F.min("position").alias("p")).collect()
    return [r["source_col"] for r in sorted(rows, key=lambda r: r["p"]) if r["source_col"] != sensitive]


def _merge(intervals: DataFrame) -> DataFrame:
    """Merge overlapping intervals per model (gaps and islands)."""
    before = Window.partitionBy("model").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("model").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    starts = intervals.withColumn("_reach", F.max("hi").over(before)).withColumn(
        "_new", (F.col("_reach").isNull() | (F.col("lo") > F.col("_reach"))).cast("int")
    )
    return (
        starts.withColumn("_island", F.sum("_new").over(running))
        .groupBy("model", "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def fold_intervals(terms: DataFrame, columns: list[str], sensitive: str) -> list[DataFrame]:
    """Reachable intervals ``(model, lo, hi)`` after 0, 1, … all categorical columns.

    Intervals that cannot reach any pair's window whatever the remaining columns add are dropped on
    the way; that changes no answer and keeps the list short. With many columns every stage is
    settled, because later stages and the witness read it again.
    """
    onehot = terms.filter("kind = 'onehot'")
    spans = onehot.filter(F.col("source_col") != sensitive).groupBy("model", "source_col").agg(
        F.min("weight").alias("wmin"), F.max("weight").alias("wmax")
    )
    window = onehot.filter(F.col("source_col") == sensitive).groupBy("model").agg(
        (-F.max("weight")).alias("w_lo"), (-F.min("weight")).alias("w_hi")
    )
    current = _start_intervals(terms).filter("not broken").select("model", "lo", "hi")
    stages = [current]
    for i, column in enumerate(columns):
        weights = onehot.filter(F.col("source_col") == column).select("model", F.col("weight").alias("w"))
        moved = current.join(weights, "model").select(
            "model", (F.col("lo") + F.col("w")).alias("lo"), (F.col("hi") + F.col("w")).alias("hi")
        )
        left = columns[i + 1 :]
        # the rest of the fold can move an interval by at most these amounts; the slack covers rounding
        rest = window.join(
            spans.filter(F.col("source_col").isin(left) if left else F.lit(False))
            .groupBy("model")
            .agg(F.sum("wmin").alias("down"), F.sum("wmax").alias("up")),
            "model",
            "left",
        ).fillna(0.0, ["down", "up"])
        slack = F.lit(1e-9) * (1 + F.abs("lo") + F.abs("hi"))
        reachable = (
            moved.join(rest, "model")
            .filter((F.col("hi") + F.col("up") + slack >= F.col("w_lo")) & (F.col("lo") + F.col("down") - slack <= F.col("w_hi")))
            .select("model", "lo", "hi")
        )
        current = _merge(reachable)
        if len(columns) > LAZY_COLUMNS:
            current = settle(current)
        stages.append(current)
    return stages


def linear_box_pairs(
    terms: DataFrame, schema: DataFrame, sensitive: str, stages: list[DataFrame] | None = None
) -> DataFrame:
    """``(model, source_group, target_group, status, margin, lo, hi, w_src, w_dst)`` per ordered pair.

    ``lo``/``hi`` bound the deciding part of the window; ``margin`` is its width, 0 marks a violation
    that hangs on one end point (computed in doubles, so treat it with care). Models with a missing
    weight or bound get ``unknown``.
    """
    if stages is None:
        stages = fold_intervals(terms, categorical_columns(schema, sensitive), sensitive)
    pairs = _sensitive_pairs(terms, sensitive)
    broken = _start_intervals(terms).select("model", "broken")
    w_lo = -F.greatest("w_src", "w_dst")
    w_hi = -F.least("w_src", "w_dst")
    meets = (F.col("hi") > F.col("w_lo")) & (F.col("lo") <= F.col("w_hi")) & (F.col("w_lo") < F.col("w_hi"))
    width = F.least("hi", "w_hi") - F.greatest("lo", "w_lo")
    windows = pairs.withColumn("w_lo", w_lo).withColumn("w_hi", w_hi)
    best = (
        windows.join(stages[-1], "model", "left")
        .withColumn("meets", F.coalesce(meets, F.lit(False)))
        .withColumn("width", F.when(F.col("meets"), width))
        .groupBy("model", "source_group", "target_group", "w_src", "w_dst")
        .agg(
            F.bool_or("meets").alias("sat"),
            F.max(
                F.when(
                    F.col("meets"),
                    F.struct("width", F.greatest("lo", "w_lo").alias("lo"), F.least("hi", "w_hi").alias("hi")),
                )
            ).alias("best"),
        )
    )
    unknown = F.col("broken") | F.col("w_src").isNull() | F.col("w_dst").isNull()
    return best.join(broken, "model").select(
        "model",
        "source_group",
        "target_group",
        F.when(unknown, "unknown").when(F.col("sat"), "sat").otherwise("unsat").alias("status"),
        F.col("best.width").alias("margin"),
        F.col("best.lo").alias("lo"),
        F.col("best.hi").alias("hi"),
        "w_src",
        "w_dst",
    )


def _sensitive_pairs(terms: DataFrame, sensitive: str) -> DataFrame:
    groups = terms.filter((F.col("kind") == "onehot") & (F.col("source_col") == sensitive)).select(
        "model", "category", "weight"
    )
    a = groups.select("model", F.col("category").alias("source_group"), F.col("weight").alias("w_src"))
    b = groups.select("model", F.col("category").alias("target_group"), F.col("weight").alias("w_dst"))
    return a.join(b, "model").filter("source_group <> target_group")


def linear_witness(
    terms: DataFrame, schema: DataFrame, sensitive: str, pairs: DataFrame, stages: list[DataFrame] | None = None
) -> DataFrame:
    """First violated pair per model with an input that shows it, in source values.

    The target ``base`` is the middle of the deciding interval. Walking the fold back picks one
    category per column that leaves a reachable rest; the numeric features are then set at the same
    relative place between their best and worst end.
    """
    columns = categorical_columns(schema, sensitive)
    if stages is None:
        stages = fold_intervals(terms, columns, sensitive)
    onehot = terms.filter("kind = 'onehot'")
    chosen = (
        pairs.filter("status = 'sat'")
        .groupBy("model")
        .agg(F.min(F.struct("source_group", "target_group", "lo", "hi", "w_src", "w_dst")).alias("p"))
        .select(
            "model", "p.source_group", "p.target_group", "p.w_src", "p.w_dst",
            ((F.col("p.lo") + F.col("p.hi")) / 2).alias("base"),
        )
        .withColumn("target", F.col("base"))
        .withColumn("cats", F.create_map().cast("map<string,string>"))
    )
    for column, stage in reversed(list(zip(columns, stages[:-1]))):
        weights = onehot.filter(F.col("source_col") == column).select(
            "model", F.col("category").alias("_c"), F.col("weight").alias("_w")
        )
        rest = F.col("target") - F.col("_w")
        gap = F.greatest(F.col("lo") - rest, rest - F.col("hi"), F.lit(0.0))
        options = chosen.join(weights, "model").join(stage, "model").withColumn("_gap", gap).withColumn("_rest", rest)
        # the pick carries the whole line along, so a line is read once per column
        kept = ["source_group", "target_group", "w_src", "w_dst", "base"]
        line = F.struct(
            *kept,
            F.col("_rest").alias("target"),
            F.map_concat("cats", F.create_map(F.lit(column), F.col("_c"))).alias("cats"),
        )
        chosen = options.groupBy("model").agg(F.min_by(line, F.struct("_gap", "_c")).alias("b")).select("model", "b.*")
        if len(columns) > LAZY_COLUMNS:
            chosen = settle(chosen)
    start = stages[0].select("model", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"))
    share = F.greatest(
        F.lit(0.0),
        F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("target") - F.col("s_lo"), F.col("s_hi") - F.col("s_lo")), F.lit(0.5))),
    )
    numeric = (
        terms.filter("kind = 'numeric'")
        .join(schema.select("feature", "mean", "scale"), "feature")
        .groupBy("model")
        .agg(F.array_sort(F.collect_list(F.struct("feature", "weight", "lo", "hi", "mean", "scale"))).alias("nums"))
    )

    def place(t: Column) -> Column:
        s = F.when(t["weight"] >= 0, F.col("share")).otherwise(1 - F.col("share"))
        z = t["lo"] + s * (t["hi"] - t["lo"])
        return F.struct(t["feature"].alias("key"), (z * t["scale"] + t["mean"]).cast("string").alias("value"))

    full = (
        chosen.join(start, "model")
        .join(numeric, "model", "left")
        .withColumn("share", share)
        .withColumn("nums", F.coalesce("nums", F.array().cast("array<struct<feature:string,weight:double,lo:double,hi:double,mean:double,scale:double>>")))
        .withColumn("shared", F.map_concat(F.map_from_entries(F.transform("nums", place)), "cats"))
    )
    score_x = F.col("base") + F.col("w_src")
    score_y = F.col("base") + F.col("w_dst")
    return full.select(
        "model",
        "source_group",
        "target_group",
        score_x.alias("score_x"),
        score_y.alias("score_y"),
        (score_x > 0).cast("int").alias("prediction_x"),
        (score_y > 0).cast("int").alias("prediction_y"),
        F.map_concat("shared", F.create_map(F.lit(sensitive), F.col("source_group"))).alias("example_x"),
        F.map_concat("shared", F.create_map(F.lit(sensitive), F.col("target_group"))).alias("example_y"),
    )


# ---------------------------------------------------------------------------------------------
# Trees and rule lists
# ---------------------------------------------------------------------------------------------


def disjoint_regions(rules: DataFrame) -> DataFrame:
    """Conjunctive regions ``(model, region, pred, conds)`` of ordered rules.

    First match wins, so rule k only holds where rules 1 … k−1 do not. Each earlier rule is
    subtracted from the region by splitting it along that rule's conditions, unless the two already
    contradict each other (as the paths of one tree always do); the rest stays exact. The table depends
    on the models only and is settled for the steps that read it.
    """
    cond = "struct<feature:string,op:string,threshold:double>"
    clash = """exists({a}, p -> exists({b}, q -> p.feature = q.feature and
                 ((p.op = '>' and q.op = '<=' and p.threshold >= q.threshold) or
                  (p.op = '<=' and q.op = '>' and q.threshold >= p.threshold))))"""
    split = f"""
      flatten(transform(boxes, box ->
        case when {clash.format(a="box", b="earlier")} then array(box)
             else filter(
               transform(sequence(1, greatest(size(earlier), 1)), i ->
                 case when i > size(earlier) then null else
                   concat(box, slice(earlier, 1, i - 1),
                          array(named_struct(
                            'feature', earlier[i - 1].feature,
                            'op', case when earlier[i - 1].op = '<=' then '>' else '<=' end,
                            'threshold', earlier[i - 1].threshold))) end),
               piece -> piece is not null and not {clash.format(a="piece", b="piece")})
        end))"""
    per_model = rules.groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("rule_no", "conds", "pred"))).alias("listed")
    )
    region = F.expr(
        f"""transform(listed, (r, k) -> named_struct('rule_no', r.rule_no, 'pred', r.pred, 'boxes',
              aggregate(transform(slice(listed, 1, k), e -> e.conds), cast(array(r.conds) as array<array<{cond}>>),
                        (boxes, earlier) -> {split})))"""
    )
    return settle(
        per_model.select("model", F.inline(region))
        .select("model", "rule_no", "pred", F.posexplode("boxes").alias("piece", "conds"))
        .select("model", F.format_string("%06d.%06d", "rule_no", "piece").alias("region"), "pred", "conds")
    )


def _feature_limits(regions: DataFrame) -> DataFrame:
    """Per region and feature the open lower and closed upper limit."""
    conds = regions.select("model", "region", F.inline("conds"))
    return conds.groupBy("model", "region", "feature").agg(
        F.max(F.when(F.col("op") == ">", F.col("threshold"))).alias("lo"),
        F.min(F.when(F.col("op") == "<=", F.col("threshold"))).alias("hi"),
    )


def _one_hot_choice(by: list[str], limits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per block: can it be set with exactly one 1, and to which categories?

    A category can be the 1 if its own limits allow 1 and every other feature of the block allows 0.
    ``barred`` lists the categories that cannot be chosen, ``forced`` the ones that must be.
    """
    one = (F.coalesce(F.col("lo"), F.lit(-1.0)) < 1.0) & (F.coalesce(F.col("hi"), F.lit(1.0)) >= 1.0)
    zero = (F.coalesce(F.col("lo"), F.lit(-1.0)) < 0.0) & (F.coalesce(F.col("hi"), F.lit(1.0)) >= 0.0)
    blocks = limits.groupBy(*by, "source_col").agg(
        F.array_sort(F.collect_list(F.when(~one, F.col("category")))).alias("barred"),
        F.array_sort(F.collect_list(F.when(~zero, F.col("category")))).alias("forced"),
    )
    ok = (
        F.when(F.size("forced") == 0, F.size("barred") < F.col("n_categories"))
        .when(F.size("forced") == 1, ~F.array_contains("barred", F.get("forced", F.lit(0))))
        .otherwise(F.lit(False))
    )
    return blocks.join(sizes, "source_col").withColumn("ok", ok)


def region_box_pairs(
    regions: DataFrame, schema: DataFrame, bounds: DataFrame, sensitive: str, values: DataFrame | None = None
) -> DataFrame:
    """``(model, source_group, target_group, status, region_x, region_y)`` per ordered pair.

    Regions of a model meet only regions of the same model and of the other class; whether two can
    hold together on the non-sensitive columns is decided once and then read by every group pair. ``values`` are the
    :func:`group_values` of a sensitive column that models see as a number.
    """
    typed = schema.select("feature", "kind", "source_col", "category")
    sizes = schema.filter("kind = 'onehot'").groupBy("source_col").agg(F.count("*").alias("n_categories"))
    limits = _feature_limits(regions).join(typed, "feature")
    if values is None:
        usable = _usable_groups(regions, limits, schema, sensitive)
        categories = schema.filter((F.col("kind") == "onehot") & (F.col("source_col") == sensitive)).select("category")
    else:
        usable = _usable_values(regions, limits, values, sensitive)
        categories = values.select("category")
    heads = regions.select("model", "region", "pred")
    lows = heads.filter("pred = 0").select("model", F.col("region").alias("r0"))
    highs = heads.filter("pred = 1").select("model", F.col("region").alias("r1"))
    both = lows.join(highs, "model")
    free = limits.filter(F.col("source_col") != sensitive)
    of_first = both.join(free.withColumnRenamed("region", "r0"), ["model", "r0"])
    of_second = both.join(free.withColumnRenamed("region", "r1"), ["model", "r1"])
    joint = (
        of_first.unionByName(of_second)
        .groupBy("model", "r0", "r1", "feature", "kind", "source_col", "category")
        .agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    )
    top = F.least(F.col("hi"), F.col("box_hi"))
    numeric_ok = (top >= F.col("box_lo")) & F.coalesce(F.col("lo") < top, F.lit(True))
    numeric = joint.filter("kind = 'numeric'").join(
        bounds.select("feature", F.col("lo").alias("box_lo"), F.col("hi").alias("box_hi")), "feature", "left"
    ).select("model", "r0", "r1", numeric_ok.alias("ok"))
    blocks = _one_hot_choice(["model", "r0", "r1"], joint.filter("kind = 'onehot'"), sizes).select(
        "model", "r0", "r1", "ok"
    )
    # a missing bound leaves the pair undecided (NULL) unless another column already rules it out
    verdict = (
        numeric.unionByName(blocks)
        .groupBy("model", "r0", "r1")
        .agg(F.bool_and("ok").alias("all_ok"), F.bool_or(F.col("ok").isNull()).alias("open"))
    )
    feasible = both.join(verdict, ["model", "r0", "r1"], "left").select(
        "model",
        "r0",
        "r1",
        F.when(F.col("all_ok") == F.lit(False), "no").when(F.col("open"), "open").otherwise("yes").alias("joint"),
    ).filter("joint <> 'no'")
    g0 = usable.select("model", F.col("region").alias("r0"), F.col("grp").alias("g0"))
    g1 = usable.select("model", F.col("region").alias("r1"), F.col("grp").alias("g1"))
    hits = feasible.join(g0, ["model", "r0"]).join(g1, ["model", "r1"]).filter("g0 <> g1")
    directed = hits.select(
        "model",
        "joint",
        F.inline(
            F.array(
                F.struct(F.col("g0").alias("source_group"), F.col("g1").alias("target_group"), F.col("r0").alias("region_x"), F.col("r1").alias("region_y")),
                F.struct(F.col("g1").alias("source_group"), F.col("g0").alias("target_group"), F.col("r1").alias("region_x"), F.col("r0").alias("region_y")),
            )
        ),
    )
    found = directed.groupBy("model", "source_group", "target_group").agg(
        F.bool_or(F.col("joint") == "yes").alias("sat"),
        F.min(F.when(F.col("joint") == "yes", F.struct("region_x", "region_y"))).alias("w"),
    )
    listed = categories.agg(F.array_sort(F.collect_list("category")).alias("gs")).scalar()
    pairs = (
        regions.select("model")
        .distinct()
        .select("model", F.explode(listed).alias("source_group"))
        .select("model", "source_group", F.explode(listed).alias("target_group"))
        .filter("source_group <> target_group")
    )
    key = ["model", "source_group", "target_group"]
    return pairs.join(found, key, "left").select(
        *key,
        F.when(F.col("sat"), "sat").when(F.col("sat").isNull(), "unsat").otherwise("unknown").alias("status"),
        F.col("w.region_x").alias("region_x"),
        F.col("w.region_y").alias("region_y"),
    )


def _usable_groups(regions: DataFrame, limits: DataFrame, schema: DataFrame, sensitive: str) -> DataFrame:
    """Groups that can be pinned in each region: ``(model, region, grp)``."""
    block = schema.filter((F.col("kind") == "onehot") & (F.col("source_col") == sensitive))
    listed = block.agg(F.array_sort(F.collect_list("category")).alias("gs")).scalar()
    sizes = block.groupBy("source_col").agg(F.count("*").alias("n_categories"))
    pinned = _one_hot_choice(["model", "region"], limits.filter(F.col("source_col") == sensitive), sizes)
    allowed = F.when(
        F.size("forced") == 0, F.array_except(listed, F.col("barred"))
    ).when(F.size("forced") == 1, F.array_except(F.col("forced"), F.col("barred"))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        regions.select("model", "region")
        .join(pinned.select("model", "region", allowed.alias("allowed")), ["model", "region"], "left")
        .select("model", "region", F.explode(F.coalesce("allowed", listed)).alias("grp"))
    )


def _usable_values(regions: DataFrame, limits: DataFrame, values: DataFrame, sensitive: str) -> DataFrame:
    """Groups whose value lies within the limits of each region: ``(model, region, grp)``."""
    own = limits.filter(F.col("source_col") == sensitive).select("model", "region", "lo", "hi")
    groups = values.select(F.lit(sensitive).alias("source_col"), F.col("category").alias("grp"), "value")
    inside = (F.col("lo").isNull() | (F.col("lo") < F.col("value"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    every = regions.select("model", "region", F.lit(sensitive).alias("source_col")).join(groups, "source_col")
    return every.join(own, ["model", "region"], "left").filter(inside).select("model", "region", "grp")


def region_witness(
    regions: DataFrame, schema: DataFrame, bounds: DataFrame, sensitive: str, pairs: DataFrame
) -> DataFrame:
    """First violated pair per model with an input that lies in both regions, in source values."""
    first = (
        pairs.filter("status = 'sat'")
        .groupBy("model")
        .agg(F.min(F.struct("source_group", "target_group", "region_x", "region_y")).alias("p"))
        .select("model", "p.*")
    )
    typed = schema.select("feature", "kind", "source_col", "category", "mean", "scale")
    limits = _feature_limits(regions)
    of_x = first.select("model", F.col("region_x").alias("region")).join(limits, ["model", "region"])
    of_y = first.select("model", F.col("region_y").alias("region")).join(limits, ["model", "region"])
    joint = of_x.unionByName(of_y).groupBy("model", "feature").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    # every feature of every model with a violation, limited or not
    features = F.array_sort(F.collect_list(F.struct("feature", "kind", "source_col", "category", "mean", "scale")))
    all_features = first.select("model", F.inline(typed.agg(features.alias("fs")).scalar())).filter(
        F.col("source_col") != sensitive
    )
    full = all_features.join(joint, ["model", "feature"], "left")
    numeric = (
        full.filter("kind = 'numeric'")
        .join(bounds.select("feature", F.col("hi").alias("box_hi")), "feature", "left")
        .select(
            "model",
            F.col("source_col").alias("key"),
            (F.least("hi", "box_hi") * F.col("scale") + F.col("mean")).cast("string").alias("value"),
        )
    )
    one = (F.coalesce(F.col("lo"), F.lit(-1.0)) < 1.0) & (F.coalesce(F.col("hi"), F.lit(1.0)) >= 1.0)
    zero = (F.coalesce(F.col("lo"), F.lit(-1.0)) < 0.0) & (F.coalesce(F.col("hi"), F.lit(1.0)) >= 0.0)
    chosen = (
        full.filter("kind = 'onehot'")
        .groupBy("model", "source_col")
        .agg(
            F.min(F.when(~zero, F.col("category"))).alias("forced"),
            F.min(F.when(one, F.col("category"))).alias("free"),
        )
        .select("model", F.col("source_col").alias("key"), F.coalesce("forced", "free").alias("value"))
    )
    shared = (
        numeric.unionByName(chosen)
        .groupBy("model")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("shared"))
    )
    preds = regions.select("model", "region", "pred")
    px = preds.select("model", F.col("region").alias("region_x"), F.col("pred").alias("prediction_x"))
    py = preds.select("model", F.col("region").alias("region_y"), F.col("pred").alias("prediction_y"))
    none = F.lit(None).cast("double")
    empty = F.create_map().cast("map<string,string>")
    return (
        first.join(shared, "model", "left")
        .withColumn("shared", F.coalesce("shared", empty))
        .join(px, ["model", "region_x"])
        .join(py, ["model", "region_y"])
        .select(
            "model",
            "source_group",
            "target_group",
            none.alias("score_x"),
            none.alias("score_y"),
            "prediction_x",
            "prediction_y",
            F.map_concat("shared", F.create_map(F.lit(sensitive), F.col("source_group"))).alias("example_x"),
            F.map_concat("shared", F.create_map(F.lit(sensitive), F.col("target_group"))).alias("example_y"),
        )
    )


