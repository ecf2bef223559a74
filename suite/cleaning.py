"""Sources and sinks (A), cleaning and scalar functions (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.functions import text
from evenhand.functions.groups import group_from_codes
from evenhand.operators import clean, metrics
from evenhand.plans import reports
from evenhand.session import scratch_path
from evenhand.sources import readers, writers
from suite import models, sql
from suite.frames import SEX_CODES, orders_frame, orders_rows, table
from suite.registry import query

# ---- A: the given tables written in the source formats and read back ---------------------------

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("a1_a7_csv_with_header", "SELECT * FROM customer")
def a1_a7_csv_with_header(spark, folder):
    path = scratch_path(spark, "customer-csv")
    writers.write_csv(table(spark, folder, "customer"), path)
    return readers.read_csv(spark, path, CUSTOMER)


@query(
    "a2_headerless_csv",
    "SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment, c_acctbal FROM customer",
)
def a2_headerless_csv(spark, folder):
    """``, ``-separated lines with ``?`` for missing values and comment lines in between."""
    path = scratch_path(spark, "customer-data")
    lines = table(spark, folder, "customer").select(
        F.concat_ws(
            ", ",
            F.col("c_custkey").cast("string"),
            F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("?")),
            F.col("c_acctbal").cast("string"),
        ).alias("value")
    )
    lines.select(F.explode(F.array(F.lit("|a comment line"), "value")).alias("value")).write.text(path)
    return readers.read_headerless_csv(spark, path, "c_custkey bigint, c_mktsegment string, c_acctbal double")


@query("a3_blank_separated", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def a3_blank_separated(spark, folder):
    path = scratch_path(spark, "orders-data")
    table(spark, folder, "orders").select(
        F.concat(
            F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("   "), "o_orderstatus", F.lit(" "),
            F.col("o_totalprice").cast("string"), F.lit("  "),
        ).alias("value")
    ).write.text(path)
    return readers.read_blank_separated(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


_PAIR_COUNT = """SELECT 'orders' AS dataset, c_mktsegment AS model, o_orderstatus AS source_group, o_orderpriority AS target_group,
  CASE WHEN count(*) % 2 = 0 THEN 'sat' ELSE 'unsat' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2, 3, 4"""


@query("a4_a8_json_documents", _PAIR_COUNT)
def a4_a8_json_documents(spark, folder):
    """Nested documents written as JSON, read back with the document schema, pairs exploded."""
    cells = (
        orders_rows(spark, folder)
        .groupBy("c_mktsegment", "o_orderstatus", "o_orderpriority")
        .agg(F.when(F.count("*") % 2 == 0, "sat").otherwise("unsat").alias("status"))
    )
    pair = F.struct(F.col("o_orderstatus").alias("source_group"), F.col("o_orderpriority").alias("target_group"), "status")
    documents = cells.groupBy(F.col("c_mktsegment").alias("model")).agg(
        F.lit("orders").alias("dataset"), F.array_sort(F.collect_list(pair)).alias("pair_checks")
    )
    path = scratch_path(spark, "documents-json")
    writers.write_json(documents, path)
    back = readers.read_documents(spark, path, lines=True)
    return readers.explode_pairs(back).select("dataset", "model", "source_group", "target_group", "status")


@query(
    "a6_tagged_union",
    """SELECT 'orders' AS dataset, o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status FROM orders
       UNION ALL BY NAME SELECT 'customer' AS dataset, c_custkey AS id, c_acctbal AS amount FROM customer""",
)
def a6_tagged_union(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status")
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")
    )
    return reports.union_tables([(orders, {"dataset": "orders"}), (customers, {"dataset": "customer"})])


@query(
    "a6_tagged_files",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'left' ELSE 'right' END AS part FROM customer",
)
def a6_tagged_files(spark, folder):
    """Two folders of CSV files in one table, each file with its tag."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    left, right = scratch_path(spark, "left"), scratch_path(spark, "right")
    writers.write_csv(customers.filter("c_mktsegment = 'BUILDING'"), left)
    writers.write_csv(customers.filter("c_mktsegment <> 'BUILDING'"), right)
    both = readers.read_tagged(
        spark, {left: {"part": "left"}, right: {"part": "right"}}, "c_custkey bigint, c_mktsegment string"
    )
    return both.select("c_custkey", "part")


@query(
    "a6_tagged_folder",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'left' ELSE 'right' END AS part FROM customer",
)
def a6_tagged_folder(spark, folder):
    """The same two folders in one scan; their files are told apart by path."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    paths = {}
    for part, rows in (("left", "c_mktsegment = 'BUILDING'"), ("right", "c_mktsegment <> 'BUILDING'")):
        paths[part] = scratch_path(spark, part)
        writers.write_csv(customers.filter(rows), paths[part])
    tags = {}
    for part, path in paths.items():
        name = path.rsplit("/", 1)[-1]
        for found in spark.read.text(path).select("_metadata.file_name").distinct().collect():
            tags[f"{name}/{found[0]}"] = {"part": part}
    both = readers.read_tagged_folder(spark, list(paths.values()), tags, "c_custkey bigint, c_mktsegment string")
    return both.select("c_custkey", "part")


@query(
    "a9_run_records",
    sql.with_(
        sql.frame(), sql.own(),
        f"q AS (SELECT model, printf('%.6f', {sql.ACCURACY}) AS accuracy, printf('%.6f', {sql.f1()}) AS f1, "
        "CAST(count(*) AS VARCHAR) AS test_size FROM own GROUP BY 1)",
        select="SELECT model AS run_id, k AS key, v AS value, TIMESTAMP '2026-01-01 00:00:00' AS run_ts FROM q, "
        "LATERAL (SELECT 'accuracy' AS k, accuracy AS v UNION ALL SELECT 'f1', f1 UNION ALL SELECT 'test_size', test_size)",
    ),
)
def a9_run_records(spark, folder):
    """Appended to a day-partitioned table and read back."""
    f = orders_frame(spark, folder)
    q = metrics.quality(metrics.prediction_counts(f, models.ORDERS_MODELS)).select(
        "model",
        F.format_string("%.6f", "accuracy").alias("accuracy"),
        F.format_string("%.6f", "f1").alias("f1"),
        "test_size",
    )
    path = scratch_path(spark, "runs")
    writers.append_run(writers.run_record(q, "model", "2026-01-01 00:00:00"), path)
    back = spark.read.parquet(path)
    return back.select("run_id", "key", "value", F.col("run_ts").cast("timestamp_ntz").alias("run_ts"))


# ---- B: cleaning and scalar functions ----------------------------------------------------------


@query("b1_drop_label", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def b1_drop_label(spark, folder):
    """A column that is not there may be listed as leakage."""
    return clean.drop_columns(table(spark, folder, "orders"), "o_orderpriority", ("o_orderdate", "no_such_column"))


@query("b2_blind", sql.with_(sql.frame(), select="SELECT row_id, o_totalprice, c_acctbal, o_orderstatus, r_name FROM oa"))
def b2_blind(spark, folder):
    f = orders_frame(spark, folder)
    blind = clean.blind(f.df, f.sensitive, f.proxies)
    return blind.drop("label", "o_orderpriority")


@query("b3_binarise", "SELECT o_orderkey, CAST(COALESCE(nullif(o_orderstatus, 'P') = 'F', FALSE) AS INTEGER) AS label FROM orders")
def b3_binarise(spark, folder):
    """A missing source value counts as 0."""
    df = table(spark, folder, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return clean.binarise(df, "status", "F").select("o_orderkey", "label")


@query("b4_strip_character", "SELECT o_orderkey, replace(o_orderpriority, '-', '') AS priority FROM orders")
def b4_strip_character(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", text.strip_character(F.col("o_orderpriority"), "-").alias("priority")
    )


@query("b5_drop_missing_label", "SELECT o_orderkey, o_orderstatus AS label FROM orders WHERE o_orderstatus <> 'P'")
def b5_drop_missing_label(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("label"))
    return clean.drop_missing_label(df, "label")


@query("b6_derive_group", sql.with_(sql.frame(), select="SELECT row_id, sex2 FROM oa"))
def b6_derive_group(spark, folder):
    df = orders_rows(spark, folder)
    return df.select("row_id", group_from_codes(F.col("c_mktsegment"), SEX_CODES).alias("sex2"))


@query(
    "b8_display_name",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS shown FROM orders",
)
def b8_display_name(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", text.display_name(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("shown")
    )


@query(
    "b10_gate_status",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'WARNING' END AS ci_status FROM orders",
)
def b10_gate_status(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "unsat").when(F.col("o_orderstatus") == "O", "Sat")
    return table(spark, folder, "orders").select("o_orderkey", text.gate_status(status).alias("ci_status"))


@query("b11_pair_text", "SELECT o_orderkey, nullif(o_orderstatus, 'P') || ' -> ' || o_orderpriority AS pair FROM orders")
def b11_pair_text(spark, folder):
    pair = text.pair_text(F.nullif("o_orderstatus", F.lit("P")), F.col("o_orderpriority"))
    return table(spark, folder, "orders").select("o_orderkey", pair.alias("pair"))


_RAW = """raw AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || '/' || (o_orderkey % 7)
  WHEN 1 THEN ' ' || o_orderkey || ' ' WHEN 2 THEN o_orderstatus WHEN 3 THEN NULL WHEN 4 THEN (o_orderkey % 3) || '.0'
  ELSE o_orderkey || '/x' END AS v FROM orders)"""


def _raw(spark, folder):
    """Numbers, fractions, fractions over zero, text and gaps, derived from the order key."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    v = (
        F.when(k % 6 == 0, F.concat(s, F.lit("/"), (k % 7).cast("string")))
        .when(k % 6 == 1, F.concat(F.lit(" "), s, F.lit(" ")))
        .when(k % 6 == 2, F.col("o_orderstatus"))
        .when(k % 6 == 4, F.concat((k % 3).cast("string"), F.lit(".0")))
        .when(k % 6 == 5, F.concat(s, F.lit("/x")))
    )
    return table(spark, folder, "orders").select("o_orderkey", v.alias("v"))


@query(
    "b12_parse_number",
    f"WITH {_RAW} SELECT o_orderkey, CASE WHEN contains(v, '/') THEN TRY_CAST(split_part(v, '/', 1) AS DOUBLE) / "
    "nullif(TRY_CAST(split_part(v, '/', 2) AS DOUBLE), 0) ELSE TRY_CAST(trim(v) AS DOUBLE) END AS number FROM raw",
)
def b12_parse_number(spark, folder):
    return _raw(spark, folder).select("o_orderkey", text.parse_number(F.col("v")).alias("number"))


@query(
    "b13_normalise_prediction",
    f"WITH {_RAW} SELECT o_orderkey, CASE TRY_CAST(trim(v) AS DOUBLE) WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE trim(v) END AS pred FROM raw",
)
def b13_normalise_prediction(spark, folder):
    return _raw(spark, folder).select("o_orderkey", text.normalise_prediction(F.col("v")).alias("pred"))


_CHANGED = "CASE o_orderstatus WHEN 'F' THEN 'Sex: a -> b' WHEN 'O' THEN 'ASAL_DAERAH: x -> y' ELSE o_orderpriority END"


def _changed():
    return (
        F.when(F.col("o_orderstatus") == "F", "Sex: a -> b")
        .when(F.col("o_orderstatus") == "O", "ASAL_DAERAH: x -> y")
        .otherwise(F.col("o_orderpriority"))
    )


def _keyword_sql(rows, otherwise):
    return (
        f"SELECT o_orderkey, CASE WHEN lower(c) LIKE '%sex%' THEN '{rows[0][1]}' "
        f"WHEN lower(c) LIKE '%asal_daerah%' THEN '{rows[1][1]}' ELSE '{otherwise}' END AS finding "
        f"FROM (SELECT o_orderkey, {_CHANGED} AS c FROM orders)"
    )


@query("b14_root_cause", _keyword_sql(reports.ROOT_CAUSES, reports.ROOT_CAUSE_OTHERWISE))
def b14_root_cause(spark, folder):
    found = text.first_keyword(_changed(), reports.ROOT_CAUSES, reports.ROOT_CAUSE_OTHERWISE)
    return table(spark, folder, "orders").select("o_orderkey", found.alias("finding"))


@query("b15_suggested_action", _keyword_sql(reports.ACTIONS, reports.ACTION_OTHERWISE))
def b15_suggested_action(spark, folder):
    found = text.first_keyword(_changed(), reports.ACTIONS, reports.ACTION_OTHERWISE)
    return table(spark, folder, "orders").select("o_orderkey", found.alias("finding"))


@query("b16_score_distance", "SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) AS distance FROM lineitem")
def b16_score_distance(spark, folder):
    distance = clean.score_distance(F.col("l_discount"), F.col("l_tax"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", distance.alias("distance"))


@query("b17_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def b17_filter(spark, folder):
    return clean.keep(table(spark, folder, "orders"), "o_orderstatus", "f").select("o_orderkey")


@query("b18_select_rename", "SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders")
def b18_select_rename(spark, folder):
    return clean.pick(table(spark, folder, "orders"), {"o_orderkey": "order_id", "o_totalprice": "amount"})


@query(
    "b19_custom_order",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
)
def b19_custom_order(spark, folder):
    """The comparison ignores row order; ``tests/test_reports.py`` looks at it."""
    counted = table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return clean.order_by_categories(counted, {"o_orderstatus": ["P", "F"], "o_orderpriority": ["5-LOW", "1-URGENT"]})
