"""Counterfactual probes (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.functions.expressions import as_group, literal
from evenhand.functions.groups import alternatives
from evenhand.operators import metrics, probes
from evenhand.operators.scorers import score_models
from evenhand.plans import audit
from suite import models, sql
from suite.frames import docs_frame, lineitem_frame, orders_frame
from suite.registry import query

DRAWS = 500
NEAREST = 500
SEED = 42

_PAIR = """SELECT o.model, o.row_id AS row_index, o.s AS orig_group, p.g AS alt_group, o.pred AS pred_orig,
       p.pred AS pred_cf, CAST(o.pred <> p.pred AS INTEGER) AS flipped
FROM own o JOIN pinned p ON o.row_id = p.row_id AND o.model = p.model AND (o.s IS NULL OR o.s <> p.g)"""


@query(
    "f1_alternatives",
    sql.with_(
        sql.frame().replace("c_mktsegment AS s", "nullif(c_mktsegment, 'MACHINERY') AS s"), sql.groups(),
        select="SELECT row_id, string_agg(g, ',' ORDER BY g) AS alternatives FROM oa JOIN grp ON s IS NULL OR s <> g GROUP BY 1",
    ),
)
def f1_alternatives(spark, folder):
    """A row without a group keeps all groups as alternatives."""
    df = orders_frame(spark, folder).df.withColumn("s", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    groups = metrics.groups_array(df, "s").scalar()
    return df.select("row_id", F.array_join(alternatives(groups, F.col("s")), ",").alias("alternatives"))


@query(
    "f2_flip",
    sql.with_(
        sql.frame(), "grp AS (SELECT 'HOUSEHOLD' AS g)", sql.pinned(models=("logreg",)),
        select="SELECT row_id, s AS orig_group, g AS alt_group, score, pred FROM pinned",
    ),
)
def f2_flip(spark, folder):
    """The score of every row as if it belonged to one given group."""
    changed = models.ORDERS_LOGREG(as_group("c_mktsegment", literal("HOUSEHOLD")))
    return orders_frame(spark, folder).df.select(
        "row_id",
        F.col("c_mktsegment").alias("orig_group"),
        F.lit("HOUSEHOLD").alias("alt_group"),
        changed.score.alias("score"),
        changed.pred.alias("pred"),
    )


_DRAWS = f"""draws AS (
  SELECT range AS draw, ('0x' || substr(md5('{SEED}:' || range), 1, 15))::BIGINT % (SELECT count(*) FROM oa) AS pick
  FROM range({DRAWS}) WHERE range < (SELECT count(*) FROM oa)),
opts AS (
  SELECT draw, row_id, s, list(g ORDER BY g) AS alts FROM draws JOIN oa ON pos = pick JOIN grp ON s IS NULL OR s <> g
  GROUP BY 1, 2, 3),
chosen AS (
  SELECT draw, row_id, alts[1 + ('0x' || substr(md5('{SEED + 1}:' || draw), 1, 15))::BIGINT % len(alts)] AS alt FROM opts)"""
_RANDOM = f"""rnd AS (
  SELECT o.model, o.row_id AS row_index, o.s AS orig_group, p.g AS alt_group, o.pred AS pred_orig, p.pred AS pred_cf,
         CAST(o.pred <> p.pred AS INTEGER) AS flipped
  FROM chosen c JOIN own o ON o.row_id = c.row_id JOIN pinned p ON p.row_id = c.row_id AND p.model = o.model AND p.g = c.alt)"""


@query(
    "f3_random_probe",
    sql.with_(sql.frame(), sql.groups(), sql.own(), sql.pinned(), _DRAWS, _RANDOM, select="SELECT * FROM rnd"),
)
def f3_random_probe(spark, folder):
    return probes.random_probe(orders_frame(spark, folder), models.ORDERS_MODELS, DRAWS, SEED)


@query("f4_f7_full_probe", sql.with_(sql.frame(), sql.groups(), sql.own(), sql.pinned(), select=_PAIR))
def f4_f7_full_probe(spark, folder):
    return probes.full_probe(orders_frame(spark, folder), models.ORDERS_MODELS)


_QUALITY = f"q AS (SELECT model, {sql.ACCURACY} AS accuracy, {sql.f1()} AS f1, count(*) AS test_size FROM own GROUP BY 1)"


def _full_summary(frame, scorers, dataset):
    groups = metrics.resolve_groups(frame)
    totals = probes.full_probe_counts(probes.response_counts(frame, scorers, groups), groups)
    return probes.full_probe_summary(totals, dataset, frame.sensitive)


def _summary_sql(baseline: str, dataset: str, sensitive: str, source: str, extra: str = "") -> str:
    return (
        f"SELECT '{baseline}' AS baseline, '{dataset}' AS dataset, q.model, '{sensitive}' AS sensitive_attribute, "
        f"TRUE AS include_sensitive_model, {extra}count(flipped) AS total_checks, "
        "CAST(COALESCE(sum(flipped), 0) AS BIGINT) AS flip_count, "
        "COALESCE(sum(flipped)::DOUBLE / NULLIF(count(flipped), 0), 0) AS flip_rate, "
        f"any_value(accuracy) AS accuracy, any_value(f1) AS f1, any_value(test_size) AS test_size "
        f"FROM q LEFT JOIN {source} d ON d.model = q.model GROUP BY q.model"
    )


@query(
    "f4_full_probe_summary",
    sql.with_(
        sql.frame(), sql.groups(), sql.own(), sql.pinned(), _QUALITY, f"det AS ({_PAIR})",
        select=_summary_sql("counterfactual_augmentation", "orders", "c_mktsegment", "det"),
    ),
)
def f4_full_probe_summary(spark, folder):
    return _full_summary(orders_frame(spark, folder), models.ORDERS_MODELS, "orders")


@query(
    "f4_full_probe_lineitem",
    sql.with_(
        sql.frame("la").replace("CAST(NULL AS BIGINT) AS row_id", "row_number() OVER () AS row_id"), sql.groups("la"),
        sql.own("la"),
        "p AS (" + " UNION ALL ".join(
            f"SELECT '{m}' AS model, CAST(({models.SQL_MODELS['la'][m]['pred'].replace('{g}', 's')}) <> "
            f"({models.SQL_MODELS['la'][m]['pred'].replace('{g}', 'g')}) AS INTEGER) AS flipped FROM la JOIN grp ON s <> g"
            for m in sql.THREE
        ) + ")",
        _QUALITY,
        select=_summary_sql("counterfactual_augmentation", "lineitem", "l_linestatus", "p"),
    ),
)
def f4_full_probe_lineitem(spark, folder):
    return _full_summary(lineitem_frame(spark, folder), models.LINEITEM_MODELS, "lineitem")


@query(
    "f5_boundary_distance",
    sql.with_(sql.frame(), sql.own(), select="SELECT row_id, model, round(abs(proba - 0.5e0), 6) AS boundary_distance FROM own"),
)
def f5_boundary_distance(spark, folder):
    scored = score_models(orders_frame(spark, folder).df, models.ORDERS_MODELS, ["row_id"])
    distance = probes.boundary_distance(F.col("proba"))
    return scored.select("row_id", "model", F.round(distance, 6).alias("boundary_distance"))


_NEAR = f"""near AS (
  SELECT model, row_id, dist FROM (
    SELECT model, row_id, abs(proba - 0.5e0) AS dist,
           row_number() OVER (PARTITION BY model ORDER BY abs(proba - 0.5e0), row_id) AS rk FROM own)
  WHERE rk <= {NEAREST})"""
_BOUNDARY = """bnd AS (
  SELECT o.model, o.row_id AS row_index, n.dist AS boundary_distance, o.s AS orig_group, p.g AS alt_group,
         o.pred AS pred_orig, p.pred AS pred_cf, o.proba AS proba_orig, p.proba AS proba_cf,
         CAST(o.pred <> p.pred AS INTEGER) AS flipped
  FROM near n JOIN own o ON o.row_id = n.row_id AND o.model = n.model
       JOIN pinned p ON p.row_id = n.row_id AND p.model = n.model AND (o.s IS NULL OR o.s <> p.g))"""


@query(
    "f6_boundary_probe",
    sql.with_(
        sql.frame(), sql.groups(), sql.own(), sql.pinned(), _NEAR, _BOUNDARY,
        select="SELECT model, row_index, round(boundary_distance, 6) AS boundary_distance, orig_group, alt_group, pred_orig, "
        "pred_cf, round(proba_orig, 6) AS proba_orig, round(proba_cf, 6) AS proba_cf, flipped FROM bnd",
    ),
)
def f6_boundary_probe(spark, folder):
    out = probes.boundary_probe(orders_frame(spark, folder), models.ORDERS_MODELS, NEAREST)
    return out.withColumns({c: F.round(c, 6) for c in ("boundary_distance", "proba_orig", "proba_cf")})


def frame_and_models(dataset: str, spark, folder):
    if dataset == "orders":
        return orders_frame(spark, folder), models.ORDERS_MODELS
    return docs_frame(spark, folder), models.DOCS_MODELS


def all_summaries(dataset: str, spark, folder, draws: int = DRAWS, nearest: int = NEAREST):
    """The three probe summaries of one dataset in one table."""
    f, scorers = frame_and_models(dataset, spark, folder)
    return audit.probe_report(f, scorers, dataset, draws, nearest, SEED)


_ALL_SELECT = (
    "SELECT *, CAST(NULL AS BIGINT) AS top_k FROM ("
    + _summary_sql("random_pair_sampling", "orders", "c_mktsegment", "rnd", "count(flipped) AS n_samples, ")
    + ") UNION ALL BY NAME SELECT *, CAST(NULL AS BIGINT) AS top_k FROM ("
    + _summary_sql("counterfactual_augmentation", "orders", "c_mktsegment", "det")
    + ") UNION ALL BY NAME SELECT * FROM ("
    + _summary_sql("boundary_focused_sampling", "orders", "c_mktsegment", "bnd", f"least({NEAREST}, any_value(test_size)) AS top_k, ")
    + ")"
)


@query(
    "f8_probe_summaries",
    sql.with_(
        sql.frame(), sql.groups(), sql.own(), sql.pinned(), _QUALITY, _DRAWS, _RANDOM, f"det AS ({_PAIR})", _NEAR, _BOUNDARY,
        select=_ALL_SELECT,
    ),
)
def f8_probe_summaries(spark, folder):
    return all_summaries("orders", spark, folder)
