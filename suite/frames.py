"""Audit frames over the test tables, and the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand import AuditFrame
from evenhand.functions.groups import group_from_codes

URGENT = ["1-URGENT", "2-HIGH"]
SEX_CODES = {"a": ["AUTOMOBILE", "BUILDING"], "b": ["FURNITURE", "HOUSEHOLD"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer and region.

    The customer join comes first, so the optimiser sees that table's true size: it is broadcast while
    small and a skew-handled shuffle join beyond that. Nations and regions are fixed lists.
    """
    places = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("o_orderpriority").isin(URGENT).cast("int").alias("label"),
            "o_orderpriority",
            "o_totalprice",
            "c_acctbal",
            "o_orderstatus",
            "r_name",
            "c_mktsegment",
            group_from_codes(F.col("c_mktsegment"), SEX_CODES).alias("sex2"),
        )
    )


def orders_frame(spark: SparkSession, folder: str) -> AuditFrame:
    return AuditFrame(
        orders_rows(spark, folder),
        label="label",
        sensitive="c_mktsegment",
        numeric=("o_totalprice", "c_acctbal"),
        categorical=("o_orderstatus", "r_name", "c_mktsegment"),
        row_id="row_id",
        proxies=("sex2",),
        dense=True,
    )


def docs_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return (
        table(spark, folder, "labels")
        .join(documents, "doc_id")
        .select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), "toxic", "n_chars", "source", "lang")
    )


def docs_frame(spark: SparkSession, folder: str) -> AuditFrame:
    return AuditFrame(
        docs_rows(spark, folder),
        label="label",
        sensitive="lang",
        numeric=("n_chars",),
        categorical=("source", "lang"),
        row_id="row_id",
    )


def lineitem_frame(spark: SparkSession, folder: str) -> AuditFrame:
    """Binary group, no unique key: for aggregates only."""
    df = table(spark, folder, "lineitem").select(
        (F.col("l_discount") >= 0.05).cast("int").alias("label"),
        "l_quantity",
        "l_extendedprice",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )
    return AuditFrame(
        df,
        label="label",
        sensitive="l_linestatus",
        numeric=("l_quantity", "l_extendedprice", "l_tax"),
        categorical=("l_returnflag", "l_linestatus"),
    )


# ------------------------------------------------------------------------------------------------
# The same frames for the oracle. Every frame has row_id, label and s (the sensitive
# value); ``pos`` is the dense row number.
# ------------------------------------------------------------------------------------------------

ORDERS_CTE = """oa AS (
  SELECT o_orderkey AS row_id, o_orderkey AS pos,
         CAST(o_orderpriority IN ('1-URGENT','2-HIGH') AS INTEGER) AS label,
         o_orderpriority, o_totalprice, c_acctbal, o_orderstatus, r_name, c_mktsegment,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'a'
              WHEN c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'b' ELSE 'unknown' END AS sex2,
         c_mktsegment AS s
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey)"""

DOCS_CTE = """da AS (
  SELECT l.doc_id AS row_id, row_number() OVER (ORDER BY l.doc_id) - 1 AS pos, quality AS label, toxic, n_chars, source, lang, lang AS s
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

LINEITEM_CTE = """la AS (
  SELECT CAST(NULL AS BIGINT) AS row_id, CAST(l_discount >= 0.05e0 AS INTEGER) AS label,
         l_quantity, l_extendedprice, l_tax, l_returnflag, l_linestatus, l_linestatus AS s
  FROM lineitem)"""

FRAME_CTE = {"oa": ORDERS_CTE, "da": DOCS_CTE, "la": LINEITEM_CTE}
