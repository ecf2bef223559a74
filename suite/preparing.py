"""Feature preparation (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand import AuditFrame
from evenhand.operators import agreement, features, fitting, metrics, ranks, splits
from evenhand.operators.features import CategoricalBlock, Encoder, NumericFeature
from suite import models, sql
from suite.frames import docs_frame, orders_frame
from suite.registry import query

# docs with gaps: the length is missing for source src3, the source is missing for src5
_DOCS = """dn AS (SELECT row_id, label, CASE WHEN source = 'src3' THEN NULL ELSE n_chars END AS n_chars,
  nullif(source, 'src5') AS source, lang FROM da)"""
_MEDIAN = "med AS (SELECT median(n_chars)::DOUBLE AS m FROM dn)"
_MODE = "md AS (SELECT source AS mode FROM dn WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_FILLED = "fl AS (SELECT row_id, label, lang, COALESCE(n_chars, m)::DOUBLE AS n_chars, COALESCE(source, mode) AS source FROM dn, med, md)"
_MOMENTS = "mo AS (SELECT avg(n_chars) AS mean, stddev_pop(n_chars) AS scale FROM fl)"
_ALL = (sql.frame("da"), _DOCS, _MEDIAN, _MODE, _FILLED, _MOMENTS)


def gappy(spark, folder):
    f = docs_frame(spark, folder)
    return f.with_df(
        f.df.withColumn("n_chars", F.when(F.col("source") != "src3", F.col("n_chars"))).withColumn(
            "source", F.nullif("source", F.lit("src5"))
        )
    )


@query("c1_median_impute", sql.with_(*_ALL[:3], select="SELECT row_id, COALESCE(n_chars, m)::DOUBLE AS n_chars FROM dn, med"))
def c1_median_impute(spark, folder):
    f = gappy(spark, folder)
    n = f.df.agg(F.count("n_chars")).first()[0]
    median = ranks.exact_medians(f.df, ["n_chars"], {"n_chars": n})["n_chars"]
    return f.df.select("row_id", F.expr(NumericFeature("n_chars", median).text()).alias("n_chars"))


@query("c1_median_large", sql.with_(sql.frame(), select="SELECT median(o_totalprice) AS price, median(c_acctbal) AS balance FROM oa"))
def c1_median_large(spark, folder):
    """The median of two columns by radix selection, in the same passes."""
    df = orders_frame(spark, folder).df
    n = df.count()
    found = ranks.exact_medians(df, ["o_totalprice", "c_acctbal"], {"o_totalprice": n, "c_acctbal": n})
    return df.agg(
        F.lit(found["o_totalprice"]).alias("price"), F.lit(found["c_acctbal"]).alias("balance")
    )


@query("c2_mode_impute", sql.with_(*_ALL[:2], _MODE, select="SELECT row_id, COALESCE(source, mode) AS source FROM dn, md"))
def c2_mode_impute(spark, folder):
    f = gappy(spark, folder)
    mode = features.most_frequent(features.category_counts(f.df, ["source"])).select("mode").scalar()
    return f.df.select("row_id", F.coalesce("source", mode).alias("source"))


@query("c3_standardise", sql.with_(*_ALL, select="SELECT row_id, round((n_chars - mean) / scale, 6) AS n_chars FROM fl, mo"))
def c3_standardise(spark, folder):
    f = gappy(spark, folder)
    encoder = features.fit_encoder(f)
    return f.df.select("row_id", F.round(F.expr(encoder.numeric[0].text()), 6).alias("n_chars"))


@query("c3_standardise_nan", sql.with_(*_ALL, select="SELECT row_id, round((n_chars - mean) / scale, 6) AS n_chars FROM fl, mo"))
def c3_standardise_nan(spark, folder):
    """NaN is a missing value: the same result as with gaps."""
    f = gappy(spark, folder)
    f = f.with_df(f.df.withColumn("n_chars", F.coalesce(F.col("n_chars").cast("double"), F.lit(float("nan")))))
    encoder = features.fit_encoder(f)
    return f.df.select("row_id", F.round(F.expr(encoder.numeric[0].text()), 6).alias("n_chars"))


_BLOCK = [f"CAST(COALESCE(lang = '{v}', FALSE) AS DOUBLE) AS \"lang={v}\"" for v in models.LANGS]


@query("c4_one_hot", sql.with_(*_ALL[:1], select=f"SELECT row_id, {', '.join(_BLOCK)} FROM da"))
def c4_one_hot(spark, folder):
    f = docs_frame(spark, folder)
    encoder = features.fit_encoder(f)
    block = encoder.block("lang")
    return f.df.select("row_id", *[F.expr(block.indicator(c)).alias(n) for n, c in zip(block.names(), block.categories)])


@query(
    "c5_assemble",
    sql.with_(
        *_ALL,
        select="SELECT row_id, round((n_chars - mean) / scale, 6) AS n_chars, "
        + ", ".join(f"CAST(source = '{v}' AS DOUBLE) AS \"source={v}\"" for v in models.SOURCES if v != "src5")
        + ", " + ", ".join(_BLOCK) + " FROM fl, mo",
    ),
)
def c5_assemble(spark, folder):
    f = gappy(spark, folder)
    out = features.fit_encoder(f).transform(f.df, ["row_id"])
    # at the smallest scale some sources do not occur; they are zero columns then
    missing = [f"source={v}" for v in models.SOURCES if v != "src5" and f"source={v}" not in out.columns]
    return out.withColumn("n_chars", F.round("n_chars", 6)).withColumns({n: F.lit(0.0) for n in missing})


@query(
    "c6_feature_schema",
    sql.with_(
        *_ALL,
        "cats AS (SELECT 'source' AS source_col, source AS category FROM dn WHERE source IS NOT NULL GROUP BY ALL "
        "UNION ALL SELECT 'lang', lang FROM dn GROUP BY ALL)",
        select="""SELECT 0 AS position, 'n_chars' AS feature, 'numeric' AS kind, 'n_chars' AS source_col, CAST(NULL AS VARCHAR) AS category,
  round(m, 6) AS median, CAST(NULL AS VARCHAR) AS mode, round(mean, 6) AS mean, round(scale, 6) AS scale FROM med, mo
UNION ALL SELECT CAST(row_number() OVER (ORDER BY source_col = 'lang', category) AS INTEGER), source_col || '=' || category, 'onehot',
  source_col, category, NULL, CASE source_col WHEN 'source' THEN (SELECT mode FROM md)
    ELSE (SELECT lang FROM dn GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END, NULL, NULL FROM cats""",
    ),
)
def c6_feature_schema(spark, folder):
    encoder = features.fit_encoder(gappy(spark, folder))
    out = encoder.schema_table(spark)
    return out.withColumns({c: F.round(c, 6) for c in ("median", "mean", "scale")})


@query(
    "c7_feature_bounds",
    sql.with_(
        sql.frame(),
        select="SELECT 'o_totalprice' AS feature, min((o_totalprice - 250000.0e0) / 144000.0e0) AS lo, "
        "max((o_totalprice - 250000.0e0) / 144000.0e0) AS hi FROM oa UNION ALL "
        "SELECT 'c_acctbal', min((c_acctbal - 4500.0e0) / 3200.0e0), max((c_acctbal - 4500.0e0) / 3200.0e0) FROM oa UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{c}={v}', min(CAST({c} = '{v}' AS DOUBLE)), max(CAST({c} = '{v}' AS DOUBLE)) FROM oa"
            for c, vs in (("o_orderstatus", "FOP"), ("r_name", models.REGIONS), ("c_mktsegment", models.SEGMENTS))
            for v in vs
        ),
    ),
)
def c7_feature_bounds(spark, folder):
    return models.ORDERS_ENCODER.bounds_table(orders_frame(spark, folder).df)


@query(
    "c8_decode",
    sql.with_(
        sql.frame(),
        select="SELECT row_id, round(o_totalprice, 6) AS o_totalprice, round(c_acctbal, 6) AS c_acctbal, o_orderstatus, r_name, "
        "nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM oa",
    ),
)
def c8_decode(spark, folder):
    """Encode and decode again; a category outside the encoder comes back as NULL."""
    known = CategoricalBlock("c_mktsegment", models.SEGMENTS[:4])
    encoder = Encoder(models.ORDERS_ENCODER.numeric, (*models.ORDERS_ENCODER.blocks[:2], known))
    encoded = encoder.transform(orders_frame(spark, folder).df, ["row_id"])
    out = encoder.decode(encoded, ["row_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("o_totalprice", "c_acctbal")})


_H = "('0x' || substr(md5('42:' || row_id), 1, 8))::BIGINT"


@query(
    "c9_hash_split",
    sql.with_(sql.frame(), select=f"SELECT row_id, CASE WHEN {_H} < 858993459 THEN 'test' ELSE 'train' END AS split FROM oa"),
)
def c9_hash_split(spark, folder):
    return splits.hash_split(orders_frame(spark, folder).df, "row_id", 0.2, portable=True).select("row_id", "split")


_SIZES = """n AS (SELECT label, count(*) AS n FROM {f} GROUP BY 1),
w AS (SELECT CAST(ceil(round(sum(n) * {share}, 9)) AS BIGINT) AS t, sum(n) AS total FROM n),
e AS (SELECT label, n, floor(t * n / total::DOUBLE) AS base, t * n / total::DOUBLE - floor(t * n / total::DOUBLE) AS frac, t FROM n, w),
z AS (SELECT label, base + CAST(row_number() OVER (ORDER BY frac DESC, label) <= t - sum(base) OVER () AS INTEGER) AS k FROM e)"""


def _split_sql(frame: str, share: float) -> str:
    return sql.with_(
        sql.frame(frame), _SIZES.format(f=frame, share=share),
        f"r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {_H}, row_id) AS rk FROM {frame})",
        select="SELECT row_id, label, CASE WHEN rk <= k THEN 'test' ELSE 'train' END AS split FROM r JOIN z USING (label)",
    )


@query("c9_exact_split", _split_sql("da", 0.3))
def c9_exact_split(spark, folder):
    df = docs_frame(spark, folder).df
    return splits.exact_stratified_split(df, "row_id", "label", 0.3, portable=True).select("row_id", "label", "split")


@query("c9_exact_split_orders", _split_sql("oa", 0.2))
def c9_exact_split_orders(spark, folder):
    df = orders_frame(spark, folder).df
    return splits.exact_stratified_split(df, "row_id", "label", 0.2, portable=True).select("row_id", "label", "split")


@query(
    "c10_predefined_split",
    sql.with_(
        sql.frame(),
        select="SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows, "
        "sum(label)::BIGINT AS n_pos FROM oa GROUP BY 1",
    ),
)
def c10_predefined_split(spark, folder):
    """Two given parts in one table, told apart by their tag."""
    df = orders_frame(spark, folder).df
    parts = df.filter("o_orderpriority <> '5-LOW'").withColumn("split", F.lit("train")).unionByName(
        df.filter("o_orderpriority = '5-LOW'").withColumn("split", F.lit("test"))
    )
    return parts.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_pos"))


@query("c11_dense_index", sql.with_(sql.frame("da"), select="SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM da"))
def c11_dense_index(spark, folder):
    return ranks.dense_index(docs_frame(spark, folder).df, ["row_id"]).select("row_id", "row_index")


@query(
    "c11_dense_index_two_keys",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS row_index FROM orders",
)
def c11_dense_index_two_keys(spark, folder):
    """A leading key that a third of the rows share still spreads over all tasks."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return ranks.dense_index(orders, ["o_orderstatus", "o_orderkey"]).select("o_orderkey", "row_index")


@query(
    "e8_split_sizes",
    sql.with_(
        sql.frame(),
        select=f"SELECT CASE WHEN {_H} < 858993459 THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows FROM oa GROUP BY 1",
    ),
)
def e8_split_sizes(spark, folder):
    return metrics.split_sizes(splits.hash_split(orders_frame(spark, folder).df, "row_id", 0.2, portable=True))


# ---- a column with more values than expressions can hold ----------------------------------------


def order_numbers(spark, folder) -> AuditFrame:
    """Line items with the number of their order as a category: more than 10,000 values from sf 0.01 on."""
    df = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        (F.col("l_discount") >= 0.05).cast("int").alias("label"),
        "l_quantity",
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("order_no"),
        "l_returnflag",
        "l_linestatus",
    )
    return AuditFrame(df, "label", "l_linestatus", ("l_quantity",), ("order_no", "l_returnflag", "l_linestatus"), row_id="row_id")


_LN = "ln AS (SELECT 'order ' || l_orderkey AS order_no, l_returnflag, l_linestatus, l_quantity FROM lineitem)"


@query(
    "c2_c6_dictionary_schema",
    sql.with_(
        _LN,
        "cats AS (" + " UNION ALL ".join(
            f"SELECT {i} AS c, '{c}' AS source_col, {c} AS category, count(*) AS n FROM ln GROUP BY {c}"
            for i, c in enumerate(("order_no", "l_returnflag", "l_linestatus"))
        ) + ")",
        "modes AS (SELECT source_col, category AS mode FROM "
        "(SELECT *, row_number() OVER (PARTITION BY source_col ORDER BY n DESC, category) AS k FROM cats) WHERE k = 1)",
        select="""SELECT 0 AS position, 'l_quantity' AS feature, 'numeric' AS kind, 'l_quantity' AS source_col, CAST(NULL AS VARCHAR) AS category,
  CAST(median(l_quantity) AS DOUBLE) AS median, CAST(NULL AS VARCHAR) AS mode, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS scale FROM ln
UNION ALL SELECT CAST(row_number() OVER (ORDER BY c, category) AS INTEGER), source_col || '=' || category, 'onehot', source_col, category,
  NULL, mode, NULL, NULL FROM cats JOIN modes USING (source_col)""",
    ),
)
def c2_c6_dictionary_schema(spark, folder):
    """Modes and positions of all categories; the wide column is numbered as a table and never listed on the driver."""
    out = features.fit_encoder(order_numbers(spark, folder)).schema_table(spark)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "scale")})


@query(
    "c5_dictionary_vectors",
    sql.with_(
        _LN,
        "slots AS (SELECT order_no, row_number() OVER (ORDER BY order_no) AS slot FROM (SELECT DISTINCT order_no FROM ln))",
        select="SELECT slot, count(*) AS n_rows, (SELECT count(*) + 6 FROM slots) AS size FROM ln JOIN slots USING (order_no) GROUP BY slot",
    ),
)
def c5_dictionary_vectors(spark, folder):
    """The assembled sparse vectors: rows per position of the wide column."""
    f = order_numbers(spark, folder)
    encoder = features.fit_encoder(f)
    shape = F.unwrap_udt("features")
    found = encoder.vectors(f.df, ["row_id"]).select(shape["indices"].alias("i"), shape["size"].alias("size"))
    last = encoder.offsets()[1]
    return (
        found.select("size", F.explode("i").alias("slot"))
        .filter((F.col("slot") >= 1) & (F.col("slot") < last))
        .groupBy("slot", "size")
        .agg(F.count("*").alias("n_rows"))
        .select(F.col("slot").cast("bigint").alias("slot"), "n_rows", F.col("size").cast("bigint").alias("size"))
    )


@query(
    "d2_dictionary_fit_agreement",
    sql.with_(
        _LN,
        select="SELECT 'lineitem' AS dataset, 'logreg' AS model, count(*) AS samples_checked, CAST(0 AS BIGINT) AS mismatch_count, "
        "100.0e0 AS match_rate, 1 + count(DISTINCT order_no) + count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) AS n_features FROM ln",
    ),
)
def d2_dictionary_fit_agreement(spark, folder):
    """A linear model with a weight for every order: MLlib's predictions on sparse vectors against joined weights, all rows."""
    f = order_numbers(spark, folder)
    fitted = fitting.fit("logreg", f)
    out = agreement.check_fitted(fitted, f.df, "row_id", "lineitem")
    return out.withColumn("n_features", F.lit(fitted.encoder.size).cast("bigint"))
