"""Scoring (D) and metrics (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.operators import fitting, metrics, splits
from evenhand.operators import scorers as S
from evenhand.plans import audit
from evenhand.session import settle
from suite import models, sql
from suite.frames import docs_frame, lineitem_frame, orders_frame
from suite.registry import query

# ---- D: models ---------------------------------------------------------------------------------


def _rounded(df):
    """Scores are compared bit by bit; probabilities go through ``exp`` and are rounded."""
    return df.withColumn("proba", F.round("proba", 6))


def _one_model(scorer):
    def run(spark, folder):
        f = orders_frame(spark, folder)
        out = S.score_models(f.df, [scorer], ["row_id"])
        return _rounded(out.select("row_id", "model", "score", "proba", "pred"))

    return run


_OWN = "SELECT row_id, model, score, round(proba, 6) AS proba, pred FROM own"
for _key, _scorer in (
    ("d4_d5_rule_list", models.ORDERS_RULES),
    ("d6_tree", models.ORDERS_TREE),
    ("d7_linear", models.ORDERS_LOGREG),
):
    query(_key, sql.with_(sql.frame(), sql.own(models=(_scorer.name,)), select=_OWN))(_one_model(_scorer))


@query(
    "d4_rule_table",
    sql.with_(
        sql.frame(),
        sql.own(models=("tree", "rulelist")),
        select="SELECT row_id, model, round(proba, 6) AS proba, pred FROM own",
    ),
)
def d4_rule_table(spark, folder):
    """The join form of rule lists: rules as a table, features as a map."""
    f = orders_frame(spark, folder)
    features = models.ORDERS_ENCODER.columns()
    values = F.create_map(*[x for n, c in features.items() for x in (F.lit(n), c)])
    rows = f.df.select(
        "row_id", values.alias("values"), F.explode(F.array(F.lit("tree"), F.lit("rulelist"))).alias("model")
    )
    rules = S.rule_table(spark, [models.ORDERS_TREE, models.ORDERS_RULES])
    return S.score_rule_table(rows, rules, ["row_id"]).select("row_id", "model", F.round("proba", 6).alias("proba"), "pred")


_BOTH_MODES = (
    sql.own(),
    sql.own(blind=True, name="blind"),
    "scored AS (SELECT * FROM own UNION ALL SELECT * FROM blind)",
)


@query(
    "d9_all_models",
    sql.with_(
        sql.frame(),
        *_BOTH_MODES,
        select="SELECT row_id, model, include_sensitive, score, round(proba, 6) AS proba, pred FROM scored",
    ),
)
def d9_all_models(spark, folder):
    f = orders_frame(spark, folder)
    return _rounded(S.score_models(f.df, models.ORDERS_MODELS + models.ORDERS_BLIND, ["row_id"]))


def _fit(kind):
    def run(spark, folder):
        fitted = fitting.fit(kind, docs_frame(spark, folder))
        if kind == "logreg":
            return S.weight_table(spark, [fitted.scorer]).withColumn("weight", F.round("weight", 6))
        return S.rule_table(spark, [fitted.scorer])

    return run


query("d1_fit_logreg")(_fit("logreg"))
query("d2_fit_tree")(_fit("tree"))
query("d3_fit_rule_list")(_fit("rulelist"))


# ---- D: are the fits right? Facts that hold for the right model, whatever found it --------------


@query(
    "d1_fit_optimum",
    sql.with_(
        sql.frame("da"),
        select="SELECT 'logreg' AS model, count(*) AS n_rows, TRUE AS at_optimum, "
        "2 + count(DISTINCT source) + count(DISTINCT lang) AS components FROM da",
    ),
)
def d1_fit_optimum(spark, folder):
    """At the fitted weights no component of the penalised loss's gradient differs from zero."""
    f = docs_frame(spark, folder)
    gradient = fitting.logreg_gradient(fitting.fit("logreg", f), f)
    return gradient.agg(
        F.lit("logreg").alias("model"), F.lit(f.df.count()).cast("bigint").alias("n_rows"),
        (F.max(F.abs("component")) < 1e-5).alias("at_optimum"), F.count("*").alias("components"),
    )


def _rule_facts(kind: str, depth: int):
    def run(spark, folder):
        f = docs_frame(spark, folder)
        scorer = fitting.fit(kind, f).scorer
        counts = settle(fitting.rule_counts(scorer, f))
        wrong = fitting.rule_mismatches(counts).count()
        out = counts.agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.lit(wrong).cast("bigint").alias("mismatches"),
            (F.max("depth") <= depth).alias("depth_kept"),
        )
        return out.withColumn("default_class", F.lit(scorer.default)) if kind == "rulelist" else out

    return run


_FACTS = "SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, CAST(0 AS BIGINT) AS mismatches, TRUE AS depth_kept"
query("d2_fit_tree_counts", sql.with_(sql.frame("da"), select=f"{_FACTS} FROM da"))(_rule_facts("tree", fitting.TREE_DEPTH))
query(
    "d3_fit_rule_counts",
    sql.with_(
        sql.frame("da"),
        select=f"{_FACTS}, CAST(count(*) FILTER (label = 1) > count(*) FILTER (label = 0) AS INTEGER) AS default_class FROM da",
    ),
)(_rule_facts("rulelist", fitting.RULE_DEPTH))


# ---- E: metrics --------------------------------------------------------------------------------


def _scored(spark, folder):
    return metrics.prediction_counts(orders_frame(spark, folder), models.ORDERS_MODELS + models.ORDERS_BLIND)


@query(
    "e1_accuracy",
    sql.with_(
        sql.frame(), *_BOTH_MODES,
        select=f"SELECT model, include_sensitive, {sql.ACCURACY} AS accuracy, count(*) AS test_size FROM scored GROUP BY 1, 2",
    ),
)
def e1_accuracy(spark, folder):
    return metrics.quality(_scored(spark, folder)).select("model", "include_sensitive", "accuracy", "test_size")


@query(
    "e2_f1",
    sql.with_(
        sql.frame(), *_BOTH_MODES,
        select=f"SELECT model, include_sensitive, {sql.f1()} AS f1 FROM scored GROUP BY 1, 2",
    ),
)
def e2_f1(spark, folder):
    return metrics.quality(_scored(spark, folder)).select("model", "include_sensitive", "f1")


_REPORT_SQL = """, c AS (
  SELECT model, include_sensitive,
    sum(CAST(label=1 AND pred=1 AS INTEGER)) AS tp, sum(CAST(label=0 AND pred=1 AS INTEGER)) AS fp,
    sum(CAST(label=1 AND pred=0 AS INTEGER)) AS fn, sum(CAST(label=0 AND pred=0 AS INTEGER)) AS tn
  FROM scored GROUP BY 1, 2),
k AS (
  SELECT model, include_sensitive, '0' AS cls, tn AS hit, tn + fn AS predicted, tn + fp AS actual, tn + fn + tn + fp AS den FROM c
  UNION ALL
  SELECT model, include_sensitive, '1', tp, tp + fp, tp + fn, tp + fp + tp + fn FROM c),
m AS (
  SELECT model, include_sensitive, cls, COALESCE(hit / NULLIF(predicted, 0)::DOUBLE, 0) AS p,
         COALESCE(hit / NULLIF(actual, 0)::DOUBLE, 0) AS r, COALESCE(2.0e0 * hit / NULLIF(den, 0), 0) AS f, actual AS n FROM k),
t AS (SELECT model, include_sensitive, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS a, tp + tn + fp + fn AS n FROM c)
SELECT model, include_sensitive, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       CAST(support AS BIGINT) AS support FROM (
  SELECT model, include_sensitive, cls AS class, p AS precision, r AS recall, f AS f1, n AS support FROM m
  UNION ALL SELECT model, include_sensitive, 'accuracy', a, a, a, n FROM t
  UNION ALL SELECT model, include_sensitive, 'macro avg', avg(p), avg(r), avg(f), sum(n) FROM m GROUP BY 1, 2
  UNION ALL SELECT model, include_sensitive, 'weighted avg', sum(p*n)/sum(n), sum(r*n)/sum(n), sum(f*n)/sum(n), sum(n) FROM m GROUP BY 1, 2)"""


@query("e3_classification_report", sql.with_(sql.frame(), *_BOTH_MODES, select="").rstrip() + _REPORT_SQL)
def e3_classification_report(spark, folder):
    out = metrics.classification_report(_scored(spark, folder))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "e4_group_rates",
    sql.with_(
        sql.frame(), *_BOTH_MODES,
        select="SELECT model, include_sensitive, s AS grp, avg(pred) AS positive_rate, count(*) AS n_rows "
        "FROM scored WHERE s IS NOT NULL GROUP BY 1, 2, 3",
    ),
)
def e4_group_rates(spark, folder):
    return metrics.group_rates(_scored(spark, folder))


_RATES = "r AS (SELECT model, include_sensitive, s, avg(pred) AS rate FROM scored WHERE s IS NOT NULL GROUP BY 1, 2, 3)"
_GAP_SQL = sql.with_(
    sql.frame(), *_BOTH_MODES, _RATES,
    select="SELECT model, include_sensitive, max(rate) - min(rate) AS dp_gap, "
    "string_agg(s || '=' || printf('%.6f', rate), ';' ORDER BY s) AS rates FROM r GROUP BY 1, 2",
)


def _rates_text(column="dp_rates"):
    pairs = F.transform(
        F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))
    )
    return F.array_join(pairs, ";")


@query("e5_parity_gap", _GAP_SQL)
def e5_parity_gap(spark, folder):
    gap = metrics.parity_gap(metrics.group_rates(_scored(spark, folder)))
    return gap.select("model", "include_sensitive", "dp_gap", _rates_text().alias("rates"))


@query(
    "e5_parity_gap_missing_group",
    sql.with_(
        sql.frame().replace("c_mktsegment AS s", "nullif(c_mktsegment, 'MACHINERY') AS s"), sql.own(models=("logreg",)),
        "r AS (SELECT model, s, avg(pred) AS rate FROM own WHERE s IS NOT NULL GROUP BY 1, 2)",
        select="SELECT model, max(rate) - min(rate) AS dp_gap, count(*) AS n_groups FROM r GROUP BY 1",
    ),
)
def e5_parity_gap_missing_group(spark, folder):
    """Rows without a group are scored but take no part in the gap."""
    f = orders_frame(spark, folder)
    f = f.with_df(f.df.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY"))))
    rates = metrics.group_rates(metrics.prediction_counts(f, [models.ORDERS_LOGREG]))
    return metrics.parity_gap(rates).select("model", "dp_gap", F.size("dp_rates").cast("bigint").alias("n_groups"))


_SWAP = "(CASE s WHEN 'F' THEN 'O' ELSE 'F' END)"


def _swap_sql(model):
    pred = models.SQL_MODELS["la"][model]["pred"]
    return f"CAST(({pred.replace('{g}', 's')}) <> ({pred.replace('{g}', _SWAP)}) AS INTEGER) AS {model}"


@query(
    "e6_binary_flip",
    sql.with_(
        sql.frame("la"),
        f"p AS (SELECT {', '.join(_swap_sql(m) for m in sql.THREE)} FROM la)",
        select=" UNION ALL ".join(
            f"SELECT '{m}' AS model, CAST(sum({m}) AS BIGINT) AS cf_flips, avg({m}) AS cf_flip_rate FROM p" for m in sql.THREE
        ),
    ),
)
def e6_binary_flip(spark, folder):
    return metrics.binary_flip_rate(lineitem_frame(spark, folder), models.LINEITEM_MODELS)


@query(
    "e6_binary_flip_undefined",
    "SELECT m AS model, CAST(NULL AS BIGINT) AS cf_flips, CAST(NULL AS DOUBLE) AS cf_flip_rate "
    "FROM (SELECT DISTINCT unnest(['tree','logreg','rulelist']) AS m FROM orders)",
)
def e6_binary_flip_undefined(spark, folder):
    """Five groups: the binary flip is not defined."""
    return metrics.binary_flip_rate(orders_frame(spark, folder), models.ORDERS_MODELS)


@query("e7_groups", "SELECT DISTINCT c_mktsegment AS grp FROM orders JOIN customer ON o_custkey = c_custkey")
def e7_groups(spark, folder):
    f = orders_frame(spark, folder)
    return metrics.groups_array(f.df, f.sensitive).select(F.explode("groups").alias("grp"))


_SUMMARY_SQL = """, cells AS (
  SELECT model, include_sensitive, max(rate) - min(rate) AS gap,
         string_agg(s || '=' || printf('%.6f', rate), ';' ORDER BY s) AS rates FROM r GROUP BY 1, 2)
SELECT '{dataset}' AS dataset, q.model, q.include_sensitive, '{sensitive}' AS sensitive_attribute, accuracy, f1,
       CASE WHEN q.include_sensitive THEN gap END AS dp_gap,
       CASE WHEN q.include_sensitive THEN rates ELSE '' END AS rates, test_size
FROM (SELECT model, include_sensitive, {accuracy} AS accuracy, {f1} AS f1, count(*) AS test_size FROM scored GROUP BY 1, 2) q
JOIN cells USING (model, include_sensitive)"""


def _summary(df):
    return df.withColumn("rates", _rates_text()).drop("dp_rates")


@query(
    "e9_experiment_summary",
    sql.with_(sql.frame(), *_BOTH_MODES, _RATES, select="").rstrip()
    + _SUMMARY_SQL.format(dataset="orders", sensitive="c_mktsegment", accuracy=sql.ACCURACY, f1=sql.f1()),
)
def e9_experiment_summary(spark, folder):
    f = orders_frame(spark, folder)
    return _summary(metrics.experiment_summary(f, models.ORDERS_MODELS + models.ORDERS_BLIND, "orders"))


@query(
    "e9_missing_label",
    sql.with_(
        sql.frame(), sql.own(),
        select=f"SELECT model, {sql.ACCURACY} AS accuracy, {sql.f1()} AS f1, count(*) AS test_size FROM own "
        "WHERE row_id % 6 <> 0 GROUP BY model",
    ),
)
def e9_missing_label(spark, folder):
    """Rows without a label are in no count."""
    f = orders_frame(spark, folder)
    f = f.with_df(f.df.withColumn("label", F.when(F.col("row_id") % 6 != 0, F.col("label"))))
    return metrics.quality(metrics.prediction_counts(f, models.ORDERS_MODELS)).drop("include_sensitive")


@query(
    "e9_experiment_summary_lineitem",
    sql.with_(
        sql.frame("la"), sql.own("la"), sql.own("la", models=("logreg",), blind=True, name="blind"),
        _BOTH_MODES[2], _RATES, select="",
    ).rstrip()
    + _SUMMARY_SQL.format(dataset="lineitem", sensitive="l_linestatus", accuracy=sql.ACCURACY, f1=sql.f1()),
)
def e9_experiment_summary_lineitem(spark, folder):
    f = lineitem_frame(spark, folder)
    return _summary(metrics.experiment_summary(f, models.LINEITEM_MODELS + [models.LINEITEM_BLIND], "lineitem"))



@query("e9_experiment_fitted")
def e9_experiment_fitted(spark, folder):
    """Split, train all kinds in both modes, summarise the test rows."""
    f = docs_frame(spark, folder)
    df = splits.exact_stratified_split(f.df, "row_id", "label", 0.3, portable=True)
    train, test = (f.with_df(df.filter(F.col("split") == part)) for part in ("train", "test"))
    return audit.experiment(train, test, "documents")
