"""Pairwise violation checks and agreement (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand import AuditFrame
from evenhand.operators import agreement, boxcheck, fitting, paircheck
from evenhand.operators import scorers as S
from evenhand.operators.features import CategoricalBlock, Encoder, NumericFeature
from evenhand.plans import audit
from evenhand.session import settle
from suite import models, sql
from suite.frames import docs_frame, lineitem_frame, orders_frame
from suite.probing import frame_and_models
from suite.registry import query
from suite.scoring import d4_rule_table

_PAIR_MODELS = [*models.ORDERS_MODELS, models.ORDERS_EQUAL]
_NAMES = (*sql.THREE, "logreg_equal")


@query(
    "g1_group_pairs",
    sql.with_(
        sql.frame(), sql.groups(),
        select="SELECT a.g AS source_group, b.g AS target_group FROM grp a JOIN grp b ON a.g <> b.g",
    ),
)
def g1_group_pairs(spark, folder):
    return paircheck.group_pairs(orders_frame(spark, folder).df, "c_mktsegment")


_PAIRS = """prs AS MATERIALIZED (
  SELECT a.model, a.g AS source_group, b.g AS target_group,
         CASE WHEN bool_or(a.pred <> b.pred) THEN 'sat' ELSE 'unsat' END AS status,
         count(*) AS rows_checked, CAST(sum(CAST(a.pred <> b.pred AS INTEGER)) AS BIGINT) AS violations,
         min(CASE WHEN a.pred <> b.pred THEN a.row_id END) AS first_row
  FROM pinned a JOIN pinned b ON a.row_id = b.row_id AND a.model = b.model AND a.g <> b.g GROUP BY 1, 2, 3)"""
# the first violated pair of each model, and the few rows that show it, before anything is joined to them twice
FIRST = (
    "fst AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY source_group, target_group) AS rn "
    "FROM prs WHERE status = 'sat') WHERE rn = 1)"
)
WITNESS = (
    "wit AS MATERIALIZED (SELECT p.model, p.row_id, p.g, p.score, p.pred FROM pinned p "
    "WHERE EXISTS (SELECT 1 FROM fst f WHERE f.model = p.model AND f.first_row = p.row_id))"
)
_PAIR_CTES = (sql.frame(), sql.groups(), sql.pinned(models=_NAMES), _PAIRS)


@query("g2_observed_pairs", sql.with_(*_PAIR_CTES, select="SELECT * FROM prs"))
def g2_observed_pairs(spark, folder):
    return paircheck.observed_pairs(orders_frame(spark, folder), _PAIR_MODELS)


@query(
    "g2_observed_pairs_lineitem",
    sql.with_(
        sql.frame("la"), sql.groups("la"),
        "p AS (" + " UNION ALL ".join(
            f"SELECT '{m}' AS model, a.g AS source_group, b.g AS target_group, "
            f"({models.SQL_MODELS['la'][m]['pred'].replace('{g}', 'a.g')}) AS x, "
            f"({models.SQL_MODELS['la'][m]['pred'].replace('{g}', 'b.g')}) AS y "
            "FROM la, grp a, grp b WHERE a.g <> b.g" for m in sql.THREE
        ) + ")",
        select="SELECT model, source_group, target_group, CASE WHEN bool_or(x <> y) THEN 'sat' ELSE 'unsat' END AS status, "
        "count(*) AS rows_checked, CAST(sum(CAST(x <> y AS INTEGER)) AS BIGINT) AS violations FROM p GROUP BY 1, 2, 3",
    ),
)
def g2_observed_pairs_lineitem(spark, folder):
    return paircheck.observed_pairs(lineitem_frame(spark, folder), models.LINEITEM_MODELS)


@query(
    "g6_g7_overall_status",
    sql.with_(
        *_PAIR_CTES,
        select="SELECT model, CASE WHEN bool_or(status = 'sat') THEN 'SAT' ELSE 'UNSAT' END AS overall_status, "
        "count(*) AS checked_pairs, count(*) FILTER (status = 'sat') AS ce_found FROM prs GROUP BY 1",
    ),
)
def g6_g7_overall_status(spark, folder):
    return paircheck.overall_status(paircheck.observed_pairs(orders_frame(spark, folder), _PAIR_MODELS))


@query(
    "g8_first_counterexample",
    sql.with_(
        *_PAIR_CTES,
        FIRST, WITNESS,
        select="""SELECT f.model, f.source_group, f.target_group, f.first_row AS row_id,
  x.score AS score_x, y.score AS score_y, x.pred AS prediction_x, y.pred AS prediction_y,
  f.source_group AS group_x, f.target_group AS group_y, r.o_orderstatus AS status_x, r.r_name AS region_y,
  r.o_totalprice AS price_x, CAST(5 AS INTEGER) AS n_features
FROM fst f JOIN wit x ON x.model = f.model AND x.row_id = f.first_row AND x.g = f.source_group
  JOIN wit y ON y.model = f.model AND y.row_id = f.first_row AND y.g = f.target_group JOIN oa r ON r.row_id = f.first_row""",
    ),
)
def g8_first_counterexample(spark, folder):
    f = orders_frame(spark, folder)
    out = paircheck.first_counterexample(f, _PAIR_MODELS, settle(paircheck.observed_pairs(f, _PAIR_MODELS)))
    x, y = F.col("example_x"), F.col("example_y")
    return out.select(
        "model", "source_group", "target_group", "row_id",
        "score_x", "score_y",
        "prediction_x", "prediction_y",
        x["c_mktsegment"].alias("group_x"), y["c_mktsegment"].alias("group_y"),
        x["o_orderstatus"].alias("status_x"), y["r_name"].alias("region_y"),
        x["o_totalprice"].cast("double").alias("price_x"), F.size(x).alias("n_features"),
    )


@query(
    "g5_one_hot_validity",
    sql.with_(
        sql.frame(),
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS source_col, count(*) AS n_rows, CAST(0 AS BIGINT) AS bad_value, "
            f"count(*) FILTER ({c} IS NULL OR {c} NOT IN ({', '.join(repr(v) for v in vals)})) AS none_set, "
            "CAST(0 AS BIGINT) AS several_set FROM oa"
            for c, vals in (
                ("o_orderstatus", ("F", "O", "P")), ("r_name", models.REGIONS), ("c_mktsegment", models.SEGMENTS[:4]),
            )
        ),
    ),
)
def g5_one_hot_validity(spark, folder):
    """One segment is left out of the encoder, so its rows have no category set."""
    blocks = (*models.ORDERS_ENCODER.blocks[:2], CategoricalBlock("c_mktsegment", models.SEGMENTS[:4]))
    encoder = Encoder((), blocks)
    return paircheck.block_violations(encoder.transform(orders_frame(spark, folder).df, ["row_id"]), encoder)


# ---- box domain --------------------------------------------------------------------------------

_LINEAR = [models.ORDERS_LOGREG, models.ORDERS_EQUAL, models.ORDERS_CATEGORICAL]


def orders_terms(spark, folder, by_priority: bool = False):
    """Weights with the observed feature bounds, over all orders or per order priority."""
    f = orders_frame(spark, folder)
    schema = models.ORDERS_ENCODER.schema_table(spark)
    weights = S.weight_table(spark, _LINEAR)
    if not by_priority:
        return boxcheck.linear_terms(weights, schema, models.ORDERS_ENCODER.bounds_table(f.df)), schema
    z = {x.name: F.expr(x.text()) for x in models.ORDERS_ENCODER.numeric}
    bounds = f.df.groupBy("o_orderpriority").agg(
        *[F.min(c).alias(f"{n}_lo") for n, c in z.items()], *[F.max(c).alias(f"{n}_hi") for n, c in z.items()]
    ).select(
        "o_orderpriority",
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("feature"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi")) for n in z
        ])),
    )
    return boxcheck.linear_terms(weights, schema, bounds, by=["o_orderpriority"]), schema


def _box_sql(segment: str) -> str:
    """Brute force: every combination of the non-sensitive categories with its own interval."""
    key = f", {segment} AS seg" if segment else ", CAST(NULL AS VARCHAR) AS seg"
    group = f"GROUP BY {segment}" if segment else ""
    name = "m.model || '|' || b.seg" if segment else "m.model"
    return f"""WITH {sql.frame()},
b AS (SELECT min((o_totalprice - 250000.0e0) / 144000.0e0) AS plo, max((o_totalprice - 250000.0e0) / 144000.0e0) AS phi,
             min((c_acctbal - 4500.0e0) / 3200.0e0) AS alo, max((c_acctbal - 4500.0e0) / 3200.0e0) AS ahi{key} FROM oa {group}),
m AS (SELECT * FROM (VALUES ('logreg', -0.1e0, 0.9e0, -0.6e0), ('logreg_equal', -0.1e0, 0.9e0, -0.6e0),
                            ('logreg_categorical', -0.3e0, 0.0e0, 0.0e0)) t(model, b0, wp, wa)),
st AS (SELECT * FROM (VALUES ('F', 0.3e0, 0.5e0), ('O', -0.25e0, -0.5e0), ('P', 0.0e0, 0.05e0)) t(c, w1, w2)),
rg AS (SELECT * FROM (VALUES ('AFRICA', 0.1e0, 0.25e0), ('AMERICA', 0.0e0, -0.25e0), ('ASIA', -0.15e0, 0.75e0),
                             ('EUROPE', 0.2e0, 0.0e0), ('MIDDLE EAST', 0.0e0, 0.0e0)) t(c, w1, w2)),
sg AS (SELECT * FROM (VALUES ('AUTOMOBILE', 0.12e0), ('BUILDING', -0.2e0), ('FURNITURE', 0.05e0), ('HOUSEHOLD', -0.08e0),
                             ('MACHINERY', 0.2e0)) t(c, w)),
iv AS (
  SELECT {name} AS model, m.model AS kind,
         (b0 + least(wa * alo, wa * ahi)) + least(wp * plo, wp * phi)
           + CASE WHEN m.model = 'logreg_categorical' THEN st.w2 ELSE st.w1 END
           + CASE WHEN m.model = 'logreg_categorical' THEN rg.w2 ELSE rg.w1 END AS lo,
         (b0 + greatest(wa * alo, wa * ahi)) + greatest(wp * plo, wp * phi)
           + CASE WHEN m.model = 'logreg_categorical' THEN st.w2 ELSE st.w1 END
           + CASE WHEN m.model = 'logreg_categorical' THEN rg.w2 ELSE rg.w1 END AS hi
  FROM m, b, st, rg),
pw AS (SELECT x.c AS source_group, y.c AS target_group, x.w AS ws, y.w AS wd FROM sg x, sg y WHERE x.c <> y.c)
SELECT model, source_group, target_group,
       CASE WHEN bool_or(CASE WHEN kind = 'logreg_equal' THEN FALSE
                              ELSE hi > -greatest(ws, wd) AND lo <= -least(ws, wd) AND ws <> wd END)
            THEN 'sat' ELSE 'unsat' END AS status
FROM iv, pw GROUP BY 1, 2, 3"""


@query("g3_box_linear", _box_sql(""))
def g3_box_linear(spark, folder):
    terms, schema = orders_terms(spark, folder)
    return boxcheck.linear_box_pairs(terms, schema, "c_mktsegment").select(
        "model", "source_group", "target_group", "status"
    )


@query("g3_box_linear_segments", _box_sql("o_orderpriority"))
def g3_box_linear_segments(spark, folder):
    """Every model in the box of every order priority, in one job."""
    terms, schema = orders_terms(spark, folder, by_priority=True)
    return boxcheck.linear_box_pairs(terms, schema, "c_mktsegment").select(
        "model", "source_group", "target_group", "status"
    )


@query("g3_box_linear_witness")
def g3_box_linear_witness(spark, folder):
    terms, schema = orders_terms(spark, folder)
    stages = boxcheck.fold_intervals(terms, boxcheck.categorical_columns(schema, "c_mktsegment"), "c_mktsegment")
    pairs = settle(boxcheck.linear_box_pairs(terms, schema, "c_mktsegment", stages))
    return boxcheck.linear_witness(terms, schema, "c_mktsegment", pairs, stages)


def orders_regions(spark):
    return boxcheck.disjoint_regions(S.rule_table(spark, [models.ORDERS_TREE, models.ORDERS_RULES]))


_GRID_SQL = f"""WITH {sql.frame()},
b AS (SELECT min((o_totalprice - 250000.0e0) / 144000.0e0) AS plo, max((o_totalprice - 250000.0e0) / 144000.0e0) AS phi,
             min((c_acctbal - 4500.0e0) / 3200.0e0) AS alo, max((c_acctbal - 4500.0e0) / 3200.0e0) AS ahi FROM oa),
pr AS (SELECT z FROM (SELECT unnest([plo, phi, 0.1e0, 0.11e0, 0.2e0, 0.21e0, 0.8e0, 0.81e0]) AS z, plo, phi FROM b) WHERE z BETWEEN plo AND phi),
ac AS (SELECT z FROM (SELECT unnest([alo, ahi, -0.5e0, -0.49e0, 0.0e0, 0.01e0, 1.0e0, 1.01e0]) AS z, alo, ahi FROM b) WHERE z BETWEEN alo AND ahi),
st AS (SELECT unnest(['F', 'O', 'P']) AS o_orderstatus),
rg AS (SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']) AS r_name),
sg AS (SELECT DISTINCT s AS g FROM oa),
gridp AS (SELECT row_number() OVER () AS cell, pr.z AS zp, ac.z AS za, o_orderstatus, r_name FROM pr, ac, st, rg),
p AS (
  SELECT cell, g, 'tree' AS model,
    CASE WHEN zp <= 0.1e0 AND g <> 'HOUSEHOLD' THEN 0 WHEN zp <= 0.1e0 AND za <= 0 THEN 1 WHEN zp <= 0.1e0 THEN 0
         WHEN r_name <> 'ASIA' THEN 1 WHEN g <> 'AUTOMOBILE' THEN 0 ELSE 1 END AS pred FROM gridp, sg
  UNION ALL
  SELECT cell, g, 'rulelist',
    CASE WHEN g = 'BUILDING' AND zp > 0.2e0 THEN 0 WHEN zp > 0.8e0 THEN 1 WHEN za <= -0.5e0 AND o_orderstatus = 'O' THEN 1
         WHEN g = 'MACHINERY' AND za > 1 THEN 1 ELSE 0 END FROM gridp, sg)
SELECT x.model, x.g AS source_group, y.g AS target_group,
       CASE WHEN bool_or(x.pred <> y.pred) THEN 'sat' ELSE 'unsat' END AS status
FROM p x JOIN p y ON x.cell = y.cell AND x.model = y.model AND x.g <> y.g GROUP BY 1, 2, 3"""


@query("g4_box_regions", _GRID_SQL)
def g4_box_regions(spark, folder):
    f = orders_frame(spark, folder)
    schema = models.ORDERS_ENCODER.schema_table(spark)
    bounds = models.ORDERS_ENCODER.bounds_table(f.df)
    out = boxcheck.region_box_pairs(orders_regions(spark), schema, bounds, "c_mktsegment")
    return out.select("model", "source_group", "target_group", "status")


@query("g4_box_regions_witness")
def g4_box_regions_witness(spark, folder):
    f = orders_frame(spark, folder)
    schema = models.ORDERS_ENCODER.schema_table(spark)
    bounds = models.ORDERS_ENCODER.bounds_table(f.df)
    bounds, regions = settle(bounds), orders_regions(spark)
    pairs = settle(boxcheck.region_box_pairs(regions, schema, bounds, "c_mktsegment"))
    return boxcheck.region_witness(regions, schema, bounds, "c_mktsegment", pairs)


# ---- a sensitive column that models see as a number --------------------------------------------

_TOXIC_ENCODER = Encoder(
    (NumericFeature("n_chars", None, 2500.0, 3000.0), NumericFeature("toxic", None, 0.25, 0.5)), (models.DOCS_ENCODER.blocks[1],)
)
_TOXIC_LINEAR = [
    S.LinearScorer("seen", _TOXIC_ENCODER, {"n_chars": 0.5, "toxic": 0.8, "lang=de": 0.1, "lang=en": -0.2}, 0.15),
    S.LinearScorer("out_of_reach", _TOXIC_ENCODER, {"toxic": 0.8, "lang=de": 0.1, "lang=en": -0.2}, 5.0),
    S.LinearScorer("unused", _TOXIC_ENCODER, {"n_chars": 0.5, "lang=de": 0.1}, 0.15),
]
_TOXIC_RULES = [
    S.TreeScorer(
        "tree", _TOXIC_ENCODER,
        (S.Node(0, "toxic", 0.0, 1, 2), S.Node(1, n0=9, n1=1), S.Node(2, "lang=fr", 0.5, 3, 4), S.Node(3, n0=9, n1=1), S.Node(4, n0=1, n1=9)),
    ),
    S.RuleListScorer("rulelist", _TOXIC_ENCODER, (S.Rule((("toxic", ">", 2.0), ("n_chars", ">", 0.0)), 1, 0.9),), 0),
]


def toxic_frame(spark, folder):
    f = docs_frame(spark, folder)
    return AuditFrame(f.df, "label", "toxic", ("n_chars", "toxic"), ("lang",), row_id="row_id")


def _toxic_box(members):
    def run(spark, folder):
        docs = audit.box_documents(toxic_frame(spark, folder), members, "documents")
        return docs.select("model", "overall_status", F.inline("pair_checks")).select(
            "model", "overall_status", "source_group", "target_group", "status"
        )

    return run


query(
    "g3_box_numeric_sensitive",
    sql.with_(
        sql.frame("da"),
        "b AS (SELECT min((n_chars - 2500.0e0) / 3000.0e0) AS lo, max((n_chars - 2500.0e0) / 3000.0e0) AS hi FROM da)",
        "g AS (SELECT DISTINCT CAST(toxic AS VARCHAR) AS g, (toxic - 0.25e0) / 0.5e0 AS z FROM da)",
        "m AS (SELECT * FROM (VALUES ('seen', 0.15e0, 0.5e0, 0.8e0, 0.1e0, -0.2e0), ('out_of_reach', 5.0e0, 0.0e0, 0.8e0, 0.1e0, -0.2e0), "
        "('unused', 0.15e0, 0.5e0, 0.0e0, 0.1e0, 0.0e0)) t(model, b0, wn, wt, de, en))",
        "iv AS (SELECT model, wt, b0 + least(wn * lo, wn * hi) + w AS l, b0 + greatest(wn * lo, wn * hi) + w AS h "
        "FROM m, b, LATERAL (SELECT unnest([de, en, 0.0e0]) AS w))",
        "p AS (SELECT model, x.g AS source_group, y.g AS target_group, "
        "CASE WHEN bool_or(wt <> 0 AND h > -greatest(wt * x.z, wt * y.z) AND l <= -least(wt * x.z, wt * y.z)) THEN 'sat' ELSE 'unsat' END AS status "
        "FROM iv, g x, g y WHERE x.g <> y.g GROUP BY 1, 2, 3)",
        select="SELECT model, CASE WHEN bool_or(status = 'sat') OVER (PARTITION BY model) THEN 'SAT' ELSE 'UNSAT' END AS overall_status, "
        "source_group, target_group, status FROM p",
    ),
)(_toxic_box(_TOXIC_LINEAR))
query(
    "g4_box_numeric_sensitive",
    sql.with_(
        sql.frame("da"),
        "g AS (SELECT DISTINCT CAST(toxic AS VARCHAR) AS g, (toxic - 0.25e0) / 0.5e0 AS z FROM da)",
        "c AS (SELECT lang, zc, g, z FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang), "
        "(SELECT (unnest([min(n_chars), max(n_chars)]) - 2500.0e0) / 3000.0e0 AS zc FROM da), g)",
        "s AS (SELECT 'tree' AS model, lang, zc, g, CASE WHEN z <= 0 THEN 0 WHEN lang = 'fr' THEN 1 ELSE 0 END AS pred FROM c "
        "UNION ALL SELECT 'rulelist', lang, zc, g, CASE WHEN z > 2 AND zc > 0 THEN 1 ELSE 0 END FROM c)",
        "p AS (SELECT x.model, x.g AS source_group, y.g AS target_group, CASE WHEN bool_or(x.pred <> y.pred) THEN 'sat' ELSE 'unsat' END AS status "
        "FROM s x JOIN s y ON x.model = y.model AND x.lang = y.lang AND x.zc = y.zc AND x.g <> y.g GROUP BY 1, 2, 3)",
        select="SELECT model, CASE WHEN bool_or(status = 'sat') OVER (PARTITION BY model) THEN 'SAT' ELSE 'UNSAT' END AS overall_status, "
        "source_group, target_group, status FROM p",
    ),
)(_toxic_box(_TOXIC_RULES))


# ---- agreement ---------------------------------------------------------------------------------


@query(
    "g9_agreement",
    sql.with_(
        sql.frame(), sql.own(models=("tree", "rulelist")),
        "x AS (SELECT a.row_id, a.pred AS l, b.pred AS r FROM own a JOIN own b USING (row_id) "
        "WHERE a.model = 'tree' AND b.model = 'rulelist')",
        select="SELECT 'orders' AS dataset, 'tree vs rulelist' AS model, count(*) AS samples_checked, "
        "count(*) FILTER (l <> r) AS mismatch_count, "
        "round(100.0e0 * (count(*) - count(*) FILTER (l <> r)) / count(*), 2) AS match_rate FROM x",
    ),
)
def g9_agreement(spark, folder):
    """Two expression forms over all rows."""
    both = _two_models(spark, folder)
    return agreement.agreement(both, "l", "r", "orders", "tree vs rulelist")


@query(
    "g9_agreement_rule_forms",
    sql.with_(
        sql.frame(),
        select="SELECT 'orders' AS dataset, 'rule chain vs rule table' AS model, 2 * count(*) AS samples_checked, "
        "CAST(0 AS BIGINT) AS mismatch_count, 100.0e0 AS match_rate FROM oa",
    ),
)
def g9_agreement_rule_forms(spark, folder):
    """The chained expression and the rule table over all rows."""
    f = orders_frame(spark, folder)
    chain = S.score_models(f.df, [models.ORDERS_TREE, models.ORDERS_RULES], ["row_id"]).select(
        "row_id", "model", F.col("pred").alias("l")
    )
    listed = d4_rule_table(spark, folder).select("row_id", "model", F.col("pred").alias("r"))
    both = chain.join(listed, ["row_id", "model"], "full")
    return agreement.agreement(both, "l", "r", "orders", "rule chain vs rule table")


@query(
    "g9_agreement_fitted",
    sql.with_(
        sql.frame("da"),
        select="SELECT 'documents' AS dataset, m AS model, count(*) AS samples_checked, CAST(0 AS BIGINT) AS mismatch_count, "
        "100.0e0 AS match_rate FROM da, (VALUES ('tree'), ('logreg'), ('rulelist')) AS k(m) GROUP BY m",
    ),
)
def g9_agreement_fitted(spark, folder):
    """MLlib's own predictions against the exported expression, on every row."""
    f = docs_frame(spark, folder)
    out = None
    for kind in ("tree", "logreg", "rulelist"):
        part = agreement.check_fitted(fitting.fit(kind, f), f.df, "row_id", "documents", None)
        out = part if out is None else out.unionByName(part)
    return out


def _two_models(spark, folder):
    f = orders_frame(spark, folder)
    return f.df.select("row_id", models.ORDERS_TREE().pred.alias("l"), models.ORDERS_RULES().pred.alias("r"))


@query(
    "g10_first_mismatches",
    sql.with_(
        sql.frame(), sql.own(models=("tree", "rulelist")),
        select="SELECT a.row_id, a.pred AS left_pred, b.pred AS right_pred FROM own a JOIN own b USING (row_id) "
        "WHERE a.model = 'tree' AND b.model = 'rulelist' AND a.pred <> b.pred ORDER BY row_id LIMIT 10",
    ),
)
def g10_first_mismatches(spark, folder):
    return agreement.mismatches(_two_models(spark, folder), "row_id", "l", "r")


def pair_documents(dataset: str, spark, folder):
    """Nested pair-check documents of one dataset."""
    f, scorers = frame_and_models(dataset, spark, folder)
    scorers = [*scorers, models.ORDERS_EQUAL] if dataset == "orders" else scorers
    return audit.observed_documents(f, scorers, dataset)


@query(
    "g4_box_blind",
    sql.with_(
        sql.frame(),
        "n AS (SELECT count(DISTINCT s) AS k FROM oa WHERE s IS NOT NULL)",
        select="SELECT model, 'UNSAT' AS overall_status, CAST(k * (k - 1) AS INTEGER) AS pairs FROM n, "
        "(VALUES ('tree'), ('logreg'), ('rulelist')) AS m(model)",
    ),
)
def g4_box_blind(spark, folder):
    """Models that do not see the sensitive column have a document each, without a violation."""
    docs = audit.box_documents(orders_frame(spark, folder), models.ORDERS_BLIND, "orders")
    return docs.select("model", "overall_status", F.size("pair_checks").alias("pairs"))


@query("g11_pair_documents")
def g11_pair_documents(spark, folder):
    return pair_documents("orders", spark, folder)


@query("g11_box_documents_fitted")
def g11_box_documents_fitted(spark, folder):
    """Fit on the documents, check the whole box: tree, linear model and rule list."""
    f = docs_frame(spark, folder)
    return audit.box_documents(f, [x.scorer for x in audit.fit_all(f)], "documents")
