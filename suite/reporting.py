"""Reports and the gate (H), on summaries of all frames × the literal models."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.functions import text
from evenhand.operators import agreement, metrics
from evenhand.plans import gate as gates
from evenhand.plans import audit, reports
from evenhand.session import scratch_path, settle
from evenhand.sources import readers, writers
from suite import models, pairs, probing, sql
from suite.frames import lineitem_frame, orders_frame
from suite.registry import query

DATASETS = ["orders", "documents", "lineitem"]
MODEL_ORDER = [*reports.SOLVER_MODEL_ORDER, "logreg_equal"]

# ---- inputs ------------------------------------------------------------------------------------


def probe_tables(spark, folder):
    return probing.all_summaries("orders", spark, folder).unionByName(probing.all_summaries("documents", spark, folder))


def experiment_tables(spark, folder):
    orders = metrics.experiment_summary(
        orders_frame(spark, folder), models.ORDERS_MODELS + models.ORDERS_BLIND, "orders"
    )
    items = metrics.experiment_summary(
        lineitem_frame(spark, folder), models.LINEITEM_MODELS + [models.LINEITEM_BLIND], "lineitem"
    )
    return orders.unionByName(items)


def documents(spark, folder):
    """Pair-check documents of two data sets with display names."""
    both = pairs.pair_documents("orders", spark, folder).unionByName(pairs.pair_documents("documents", spark, folder))
    return settle(both.withColumn("model", text.display_name(F.col("model"), reports.MODEL_NAMES)))


def summary_of(docs):
    return reports.solver_summary(docs, DATASETS, MODEL_ORDER)


def agreement_rows(spark, folder):
    out = None
    for dataset in ("orders", "documents"):
        f, scorers = probing.frame_and_models(dataset, spark, folder)
        tree, _, rules = scorers
        both = f.df.select("row_id", tree().pred.alias("l"), rules().pred.alias("r"))
        part = agreement.agreement(both, "l", "r", dataset, "tree vs rulelist")
        out = part if out is None else out.unionByName(part)
    return out


# ---- the same inputs for the oracle ------------------------------------------------------------

_PRETTY = (
    "CASE {m} WHEN 'tree' THEN 'Decision Tree' WHEN 'logreg' THEN 'Logistic Regression' "
    "WHEN 'rulelist' THEN 'Rule List' ELSE {m} END"
)


def _d(*texts: str) -> list[str]:
    return [sql.suffixed(t, "_d", "da") for t in texts]


_QUALITY = probing._QUALITY.replace("q AS (", "qual AS (", 1)


def _probe_rows(dataset: str, sensitive: str) -> str:
    def one(baseline, source):
        return probing._summary_sql(baseline, dataset, sensitive, source).replace("FROM q LEFT", "FROM qual q LEFT")

    return " UNION ALL ".join(
        [
            one("random_pair_sampling", "rnd"),
            one("counterfactual_augmentation", "det"),
            one("boundary_focused_sampling", "bnd"),
        ]
    )


_ORDER_BLOCKS = [
    sql.groups(), sql.own(), sql.pinned(), _QUALITY, probing._DRAWS, probing._RANDOM, f"det AS ({probing._PAIR})",
    probing._NEAR, probing._BOUNDARY,
]
_DOC_BLOCKS = _d(
    sql.groups(), sql.own("da"), sql.pinned("da"), _QUALITY, probing._DRAWS, probing._RANDOM,
    f"det AS ({probing._PAIR})", probing._NEAR, probing._BOUNDARY,
)
_PROBE_CTES = [
    sql.frame(), sql.frame("da"), *_ORDER_BLOCKS, *_DOC_BLOCKS,
    "probe_rows AS (" + _probe_rows("orders", "c_mktsegment") + " UNION ALL "
    + sql.suffixed(_probe_rows("documents", "lang"), "_d", "da") + ")",
    """wide AS (
  SELECT dataset, model, sensitive_attribute,
         max(CASE WHEN baseline = 'random_pair_sampling' THEN flip_rate END) AS rr,
         max(CASE WHEN baseline = 'counterfactual_augmentation' THEN flip_rate END) AS cc,
         max(CASE WHEN baseline = 'boundary_focused_sampling' THEN flip_rate END) AS bb
  FROM probe_rows GROUP BY 1, 2, 3)""",
]


@query(
    "h1_probe_pivot",
    sql.with_(
        *_PROBE_CTES,
        select=f"SELECT dataset, model, {_PRETTY.format(m='model')} AS model_pretty, sensitive_attribute, "
        "rr AS random_pair_sampling, cc AS counterfactual_augmentation, bb AS boundary_focused_sampling FROM wide",
    ),
)
def h1_probe_pivot(spark, folder):
    return reports.pivot_probes(probe_tables(spark, folder))


def _experiment_rows(dataset: str, sensitive: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, x.model, x.include_sensitive, '{sensitive}' AS sensitive_attribute, accuracy, f1,
  CASE WHEN x.include_sensitive THEN gap END AS dp_gap, CASE WHEN x.include_sensitive THEN rates ELSE '' END AS dp_rates
FROM (SELECT model, include_sensitive, {sql.ACCURACY} AS accuracy, {sql.f1()} AS f1 FROM scored GROUP BY 1, 2) x
JOIN (SELECT model, include_sensitive, max(rate) - min(rate) AS gap,
             string_agg(s || '=' || printf('%.6f', rate), ';' ORDER BY s) AS rates FROM r GROUP BY 1, 2) y
  ON x.model = y.model AND x.include_sensitive = y.include_sensitive"""


_RATES = "r AS (SELECT model, include_sensitive, s, avg(pred) AS rate FROM scored WHERE s IS NOT NULL GROUP BY 1, 2, 3)"
_BOTH = "scored AS (SELECT * FROM own UNION ALL SELECT * FROM blind)"


def _l(*texts: str) -> list[str]:
    return [sql.suffixed(t, "_l", "la") for t in texts]


_EXPERIMENT_BLOCKS = [
    sql.frame("la"),
    sql.own(blind=True, name="blind"), _BOTH, _RATES,
    *_l(sql.own("la"), sql.own("la", models=("logreg",), blind=True, name="blind"), _BOTH, _RATES),
    "experiments AS (" + _experiment_rows("orders", "c_mktsegment") + " UNION ALL "
    + sql.suffixed(_experiment_rows("lineitem", "l_linestatus"), "_l", "la") + ")",
]


def _rates_text(df):
    pairs_ = F.transform(
        F.map_entries("dp_rates"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))
    )
    return df.withColumn("dp_rates", F.array_join(pairs_, ";"))


@query(
    "h2_final_summary",
    sql.with_(
        *_PROBE_CTES, *_EXPERIMENT_BLOCKS,
        select=f"SELECT e.dataset, {_PRETTY.format(m='e.model')} AS model, e.sensitive_attribute, accuracy, f1, dp_gap, "
        "rr AS baseline_random_flip_rate, cc AS baseline_counterfactual_flip_rate, bb AS baseline_boundary_flip_rate, dp_rates "
        "FROM experiments e LEFT JOIN wide w ON w.dataset = e.dataset AND w.model = e.model "
        "AND w.sensitive_attribute = e.sensitive_attribute WHERE include_sensitive",
    ),
)
def h2_final_summary(spark, folder):
    """Line items have no probes: their rates stay NULL."""
    out = reports.final_summary(experiment_tables(spark, folder), probe_tables(spark, folder), DATASETS)
    return _rates_text(out)


@query(
    "h3_removal_ablation",
    sql.with_(
        sql.frame(), sql.own(), *_EXPERIMENT_BLOCKS,
        select=f"""SELECT a.dataset, {_PRETTY.format(m='a.model')} AS model, a.sensitive_attribute,
  a.accuracy AS accuracy_with_sensitive, b.accuracy AS accuracy_without_sensitive, b.accuracy - a.accuracy AS delta_accuracy,
  a.f1 AS f1_with_sensitive, b.f1 AS f1_without_sensitive, b.f1 - a.f1 AS delta_f1, a.dp_gap AS dp_gap_with_sensitive
FROM experiments a JOIN experiments b ON a.dataset = b.dataset AND a.model = b.model
WHERE a.include_sensitive AND NOT b.include_sensitive""",
    ),
)
def h3_removal_ablation(spark, folder):
    return reports.removal_ablation(experiment_tables(spark, folder))


@query(
    "h4_probe_ablation",
    sql.with_(
        *_PROBE_CTES,
        select=f"SELECT dataset, {_PRETTY.format(m='model')} AS model, sensitive_attribute, rr AS random_flip_rate, "
        "cc AS counterfactual_flip_rate, bb AS boundary_flip_rate, "
        "CASE WHEN rr >= cc AND rr >= bb THEN 'random_pair_sampling' WHEN cc >= bb THEN 'counterfactual_augmentation' "
        "ELSE 'boundary_focused_sampling' END AS strongest_baseline FROM wide",
    ),
)
def h4_probe_ablation(spark, folder):
    return reports.probe_ablation(probe_tables(spark, folder))


_NAMES = (*sql.THREE, "logreg_equal")


def _summary_rows(dataset: str, sensitive: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, {_PRETTY.format(m='p.model')} AS model, p.model AS raw_model,
  '{sensitive}' AS sensitive_attribute, FALSE AS timeout, CAST(100 AS BIGINT) AS ce_bound,
  count(*) FILTER (p.status = 'sat') AS ce_found,
  CASE WHEN bool_or(p.status = 'sat') THEN 'SAT' ELSE 'UNSAT' END AS solver_status,
  CASE WHEN bool_or(p.status = 'sat') THEN 'FAIL' ELSE 'PASS' END AS ci_status,
  CAST(count(*) AS INTEGER) AS checked_pairs, bool_or(p.status = 'sat') AS has_counterexample,
  any_value(f.source_group) || ' -> ' || any_value(f.target_group) AS first_counterexample_pair,
  any_value(f.source_group) AS src, any_value(f.target_group) AS dst, any_value(f.first_row) AS first_row
FROM prs p LEFT JOIN fst f ON f.model = p.model GROUP BY p.model"""


_SOLVER_CTES = [
    sql.frame(), sql.frame("da"), sql.groups(), sql.pinned(models=_NAMES), pairs._PAIRS, pairs.FIRST, pairs.WITNESS,
    *_d(sql.groups(), sql.pinned("da"), pairs._PAIRS, pairs.FIRST, pairs.WITNESS),
    "solver AS (" + _summary_rows("orders", "c_mktsegment") + " UNION ALL "
    + sql.suffixed(_summary_rows("documents", "lang"), "_d", "da") + ")",
]


@query(
    "h5_solver_summary",
    sql.with_(
        *_SOLVER_CTES,
        select="SELECT dataset, model, sensitive_attribute, CAST(NULL AS DOUBLE) AS runtime_seconds, timeout, ce_bound, ce_found, "
        "solver_status, ci_status, checked_pairs, has_counterexample, first_counterexample_pair, "
        "'observed rows' AS encoding_scope, 'existence of two inputs equal on all non-sensitive transformed features, different on '"
        " || sensitive_attribute || ', with different model predictions' AS fairness_property FROM solver",
    ),
)
def h5_solver_summary(spark, folder):
    return summary_of(documents(spark, folder))


@query(
    "h6_status_counts",
    sql.with_(
        *_SOLVER_CTES,
        select='SELECT count(*) FILTER (ci_status = \'PASS\') AS "pass", count(*) FILTER (ci_status = \'FAIL\') AS fail, '
        "count(*) FILTER (ci_status = 'WARNING') AS warning, count(*) AS total FROM solver",
    ),
)
def h6_status_counts(spark, folder):
    return reports.status_counts(summary_of(documents(spark, folder)))


_REPORT = """report AS MATERIALIZED (
  SELECT s.dataset, s.model, s.sensitive_attribute, solver_status, ci_status, first_counterexample_pair AS counterexample_pair,
         CAST(x.pred AS VARCHAR) AS prediction_x, CAST(y.pred AS VARCHAR) AS prediction_y, x.score AS score_x_float,
         y.score AS score_y_float, CAST(1 AS BIGINT) AS changed_features_count,
         s.sensitive_attribute || ': ' || src || ' -> ' || dst AS changed_features
  FROM solver s
  JOIN (SELECT 'orders' AS dataset, * FROM wit UNION ALL SELECT 'documents', * FROM wit_d) x
    ON x.dataset = s.dataset AND x.model = s.raw_model AND x.row_id = s.first_row AND x.g = src
  JOIN (SELECT 'orders' AS dataset, * FROM wit UNION ALL SELECT 'documents', * FROM wit_d) y
    ON y.dataset = s.dataset AND y.model = s.raw_model AND y.row_id = s.first_row AND y.g = dst
  WHERE solver_status = 'SAT')"""


def _report(spark, folder):
    docs = documents(spark, folder)
    return reports.counterexample_report(summary_of(docs), docs)


@query(
    "h8_h9_h10_counterexample_report",
    sql.with_(*_SOLVER_CTES, _REPORT, select="SELECT * FROM report"),
)
def h8_h9_h10_counterexample_report(spark, folder):
    return _report(spark, folder).drop("score_x_raw", "score_y_raw")


def _written(spark, document, name, schema=None):
    """A document written to a file and read back by its own schema."""
    path = scratch_path(spark, name)
    writers.write_json(document, path)
    return readers.read_documents(spark, path, schema or document.schema, lines=True)


@query(
    "h5_solver_document_file",
    sql.with_(
        *_SOLVER_CTES,
        select="SELECT dataset, model, sensitive_attribute, ce_found, solver_status, ci_status, checked_pairs, first_counterexample_pair, "
        "CAST(row_number() OVER (ORDER BY CASE dataset WHEN 'orders' THEN 0 ELSE 1 END, "
        "CASE model WHEN 'Decision Tree' THEN 0 WHEN 'Rule List' THEN 1 WHEN 'Logistic Regression' THEN 2 ELSE 3 END) - 1 AS INTEGER) AS place, "
        "CASE solver_status WHEN 'SAT' THEN 'FAIL (counterexample found)' "
        "ELSE 'PASS (no counterexample found for the encoded fairness property)' END AS meaning FROM solver",
    ),
)
def h5_solver_document_file(spark, folder):
    """Pair-check documents to files, files to the summary document, and that from its file: results in order."""
    docs = _written(spark, documents(spark, folder), "pair-documents", readers.PAIR_DOCUMENT)
    back = _written(spark, reports.solver_document(summary_of(docs), DATASETS, MODEL_ORDER), "solver-document")
    rows = back.select("interpretation", F.posexplode("results").alias("place", "r"))
    return rows.select(
        "r.dataset", "r.model", "r.sensitive_attribute", "r.ce_found", "r.solver_status", "r.ci_status", "r.checked_pairs",
        "r.first_counterexample_pair", "place", F.col("interpretation")[F.col("r.solver_status")].alias("meaning"),
    )


@query(
    "h8_counterexample_document_file",
    sql.with_(
        *_SOLVER_CTES, _REPORT,
        select="SELECT dataset, model, counterexample_pair, split_part(counterexample_pair, ' -> ', 1) AS source_group, "
        "split_part(counterexample_pair, ' -> ', 2) AS target_group, prediction_x, prediction_y, score_x_float, score_y_float, "
        "sensitive_attribute AS feature, changed_features_count AS n_changed, (SELECT count(*) FROM report) AS num_counterexamples, "
        "'formal_counterexample_report' AS report_type, 'observed rows' AS encoding_scope FROM report",
    ),
)
def h8_counterexample_document_file(spark, folder):
    """The whole chain by files: documents, summary document, counterexample document with nested entries."""
    docs = _written(spark, documents(spark, folder), "pair-documents", readers.PAIR_DOCUMENT)
    solver = _written(spark, reports.solver_document(summary_of(docs), DATASETS, MODEL_ORDER), "solver-document")
    summary = solver.select(F.inline("results"))
    back = _written(spark, reports.counterexample_document(summary, docs, DATASETS, MODEL_ORDER), "counterexamples")
    return back.select("report_type", "num_counterexamples", F.explode("entries").alias("e")).select(
        "e.dataset", "e.model", "e.counterexample_pair", "e.source_group", "e.target_group", "e.prediction_x", "e.prediction_y",
        "e.score_x_float", "e.score_y_float", F.col("e.changed_features")[0]["feature"].alias("feature"),
        F.size("e.changed_features").cast("bigint").alias("n_changed"), "num_counterexamples", "report_type", "e.encoding_scope",
    )


@query(
    "g11_document_facts",
    sql.with_(
        sql.frame("da"), "n AS (SELECT count(*) AS n FROM da)",
        select="SELECT model, kind, num_rules, tree_max_depth, rulelist_max_depth, logreg_intercept, n AS n_train_rows, n AS n_test_rows FROM n, "
        "(VALUES ('tree', 'tree', 3, 2, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE)), ('rulelist', 'rulelist', 3, NULL, 2, NULL), "
        "('logreg', 'logreg', NULL, NULL, NULL, 0.15e0)) AS m(model, kind, num_rules, tree_max_depth, rulelist_max_depth, logreg_intercept)",
    ),
)
def g11_document_facts(spark, folder):
    """Depth, rules, intercept and numbers of rows in the documents, after a round through a file."""
    f, scorers = probing.frame_and_models("documents", spark, folder)
    n = f.df.count()
    docs = audit.observed_documents(f, scorers, "documents", rows=(n, n))
    back = _written(spark, docs, "pair-documents", readers.PAIR_DOCUMENT)
    return back.select(
        "model", "kind", "num_rules", "tree_max_depth", "rulelist_max_depth", "logreg_intercept", "n_train_rows", "n_test_rows"
    )


@query(
    "h9_h10_example_diff",
    """SELECT o_orderkey,
         CASE WHEN o_orderkey % 2 = 0 THEN 'status: ' || o_orderstatus || ' -> None' ELSE '' END
           || CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN '; ' ELSE '' END
           || CASE WHEN o_orderstatus <> 'F' THEN 'target: ' || o_orderstatus || ' -> F' ELSE '' END AS changed,
         CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderstatus <> 'F' AS INTEGER) AS n_changed
       FROM orders""",
)
def h9_h10_example_diff(spark, folder):
    """Examples with unequal keys and missing values."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    even = F.col("o_orderkey") % 2 == 0
    s = F.col("o_orderstatus")
    x = F.create_map(F.lit("target"), s, F.lit("status"), s)
    y = F.when(even, F.create_map(F.lit("target"), F.lit("F"))).otherwise(
        F.create_map(F.lit("status"), s, F.lit("target"), F.lit("F"))
    )
    diff = text.example_diff(x, y)
    return orders.select("o_orderkey", text.diff_text(diff).alias("changed"), F.size(diff).alias("n_changed"))


@query(
    "h11_root_cause_report",
    sql.with_(
        *_SOLVER_CTES, _REPORT,
        select="SELECT dataset, model, sensitive_attribute, counterexample_pair, prediction_x, prediction_y, score_x_float, "
        "score_y_float, abs(score_y_float - score_x_float) AS boundary_distance, "
        "CASE WHEN contains(lower(changed_features), 'mktsegment') THEN 'market segment decides' "
        "ELSE 'Fairness violation detected' END AS root_cause, "
        "'Investigate feature influence' AS suggested_action FROM report",
    ),
)
def h11_root_cause_report(spark, folder):
    causes = [("MKTSEGMENT", "market segment decides")]
    return reports.root_cause_report(_report(spark, folder), causes=causes)


def _agreement_sql(dataset: str, own: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, 'tree vs rulelist' AS model, count(*) AS samples_checked,
  count(*) FILTER (l <> r) AS mismatch_count FROM (
    SELECT a.row_id, a.pred AS l, b.pred AS r FROM {own} a JOIN {own} b USING (row_id)
    WHERE a.model = 'tree' AND b.model = 'rulelist')"""


_AGREEMENT_CTES = [
    sql.frame(), sql.frame("da"), sql.own(name="own"), *_d(sql.own("da")),
    "agr AS (" + _agreement_sql("orders", "own") + " UNION ALL " + _agreement_sql("documents", "own_d") + ")",
    "totals AS (SELECT count(*) AS n_rows, CAST(sum(samples_checked) AS BIGINT) AS samples, CAST(sum(mismatch_count) AS BIGINT) AS mismatch FROM agr)",
]
_RATE = "round(100.0e0 * (samples - mismatch) / samples, 2)"


@query(
    "h12_agreement_summary",
    sql.with_(
        *_AGREEMENT_CTES, select=f'SELECT n_rows AS "rows", samples, mismatch, {_RATE} AS match_rate FROM totals'
    ),
)
def h12_agreement_summary(spark, folder):
    return reports.agreement_totals(agreement_rows(spark, folder))


@query(
    "h13_gate",
    sql.with_(
        *_SOLVER_CTES,
        select="SELECT CASE WHEN bool_or(ci_status = 'FAIL') THEN 'FAIL' WHEN bool_or(ci_status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END "
        "AS overall_status, CASE WHEN bool_or(ci_status = 'FAIL') THEN 1 WHEN bool_or(ci_status = 'WARNING') THEN 2 ELSE 0 END AS exit_code, "
        "count(*) FILTER (ci_status = 'PASS') AS n_pass, count(*) FILTER (ci_status = 'FAIL') AS n_fail, "
        "count(*) FILTER (ci_status = 'WARNING') AS n_warning, count(*) AS n_total FROM solver",
    ),
)
def h13_gate(spark, folder):
    return gates.gate(summary_of(documents(spark, folder)))


@query(
    "h13_gate_missing",
    sql.with_(
        *_SOLVER_CTES,
        "wanted AS (SELECT ci_status FROM solver WHERE ci_status <> 'FAIL' UNION ALL SELECT 'WARNING')",
        select="SELECT CASE WHEN bool_or(ci_status = 'FAIL') THEN 'FAIL' WHEN bool_or(ci_status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END "
        "AS overall_status, CASE WHEN bool_or(ci_status = 'FAIL') THEN 1 WHEN bool_or(ci_status = 'WARNING') THEN 2 ELSE 0 END AS exit_code, "
        "count(*) FILTER (ci_status = 'PASS') AS n_pass, count(*) FILTER (ci_status = 'FAIL') AS n_fail, "
        "count(*) FILTER (ci_status = 'WARNING') AS n_warning, count(*) AS n_total FROM wanted",
    ),
)
def h13_gate_missing(spark, folder):
    """A model that was expected and has no result is a warning."""
    summary = settle(summary_of(documents(spark, folder)).filter("ci_status <> 'FAIL'"))
    names = summary.select("dataset", "model")
    absent = spark.createDataFrame([("orders", "Absent Model")], names.schema)
    return gates.gate(summary, names.union(absent))


_ORDERED = (
    "string_agg(dataset || ' / ' || model, '; ' ORDER BY list_position(['orders','documents'], dataset), "
    "list_position(['Decision Tree','Rule List','Logistic Regression','logreg_equal'], model))"
)
_LISTS = ", ".join(
    f"COALESCE({_ORDERED} FILTER (ci_status = '{s}'), '') AS {n}"
    for s, n in (("FAIL", "failed_models"), ("WARNING", "warning_models"), ("PASS", "passed_models"))
)


@query("h14_gate_lists", sql.with_(*_SOLVER_CTES, select=f"SELECT {_LISTS} FROM solver"))
def h14_gate_lists(spark, folder):
    out = gates.gate_lists(summary_of(documents(spark, folder)), DATASETS, MODEL_ORDER)
    return out.select(*[F.array_join(c, "; ").alias(c) for c in out.columns])


@query(
    "h15_gate_agreement",
    sql.with_(
        *_AGREEMENT_CTES,
        select=f'SELECT n_rows AS "rows", samples, mismatch, {_RATE} AS match_rate, '
        "CASE WHEN mismatch = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM totals",
    ),
)
def h15_gate_agreement(spark, folder):
    return gates.agreement_block(agreement_rows(spark, folder))


@query(
    "h16_gate_document",
    sql.with_(
        *_SOLVER_CTES, *_AGREEMENT_CTES[2:],
        select=f"""SELECT '2026-01-01T00:00:00Z' AS generated_at_utc, 'FAIL' AS overall_status, 1 AS exit_code,
  count(*) FILTER (ci_status = 'PASS') AS n_pass, count(*) FILTER (ci_status = 'FAIL') AS n_fail, {_LISTS.split(", COALESCE")[0]},
  (SELECT {_RATE} FROM totals) AS match_rate, 'solver summary' AS formal_summary FROM solver
HAVING bool_or(ci_status = 'FAIL')""",
    ),
)
def h16_gate_document(spark, folder):
    summary = summary_of(documents(spark, folder))
    doc = gates.gate_document(
        summary, agreement_rows(spark, folder), {"formal_summary": "solver summary"}, "2026-01-01T00:00:00Z",
        DATASETS, MODEL_ORDER,
    )
    return doc.select(
        "generated_at_utc", "overall_status", "exit_code",
        F.col("counts.pass").alias("n_pass"), F.col("counts.fail").alias("n_fail"),
        F.array_join("failed_models", "; ").alias("failed_models"),
        F.col("encoder_validation.match_rate").alias("match_rate"),
        F.col("inputs.formal_summary").alias("formal_summary"),
    )


@query(
    "h16_result_table",
    sql.with_(
        *_SOLVER_CTES,
        select="SELECT dataset, model, sensitive_attribute, solver_status, ci_status, checked_pairs, has_counterexample, "
        "first_counterexample_pair FROM solver",
    ),
)
def h16_result_table(spark, folder):
    return gates.result_table(summary_of(documents(spark, folder)))


