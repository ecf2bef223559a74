"""Fitting with MLlib's distributed estimators and reading the result back as a scorer."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import MatrixUDT, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.frame import AuditFrame
from evenhand.functions.expressions import number, plain
from evenhand.operators import profiled
from evenhand.operators.features import CategoricalBlock, DictionaryBlock, Encoder, fit_encoder
from evenhand.operators.scorers import LinearScorer, Node, RuleListScorer, TreeScorer, all_of, rule_list_from_tree
from evenhand.session import scratch_path, settle

KINDS = ("tree", "logreg", "rulelist")
TREE_DEPTH = 5
RULE_DEPTH = 3
MAX_BINS = 256
#: Weights of a wide column that one MLlib model holds, and rows of a partition that is scored with it.
PART, PART_ROWS = 1 << 20, 500_000
MODEL_FIELDS = {"numClasses": "int", "numFeatures": "int", "interceptVector": "void", "coefficientMatrix": "void", "isMultinomial": "boolean"}


@dataclass(frozen=True)
class Fitted:
    """A trained MLlib model next to the expression that scores like it."""

    model: object
    scorer: LinearScorer | TreeScorer | RuleListScorer
    encoder: Encoder

    def library_predictions(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Predictions of the MLlib model itself, for the agreement check."""
        vectors = assemble(df, self.encoder, keep)
        return self.model.transform(vectors).select(*keep, F.col("prediction").cast("int").alias("library_pred"))


def assemble(df: DataFrame, encoder: Encoder, keep: list[str]) -> DataFrame:
    """Kept columns and ``features``; with dictionary columns a sparse vector."""
    if encoder.dictionaries:
        return encoder.vectors(df, keep)
    features = encoder.columns()
    plain = df.select(*keep, *[c.alias(f"_f{i}") for i, c in enumerate(features.values())])
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features")
    return assembler.transform(plain).select(*keep, "features")


def fit(
    kind: str,
    frame: AuditFrame,
    name: str | None = None,
    include_sensitive: bool = True,
    drop_proxies: bool = False,
    encoder: Encoder | None = None,
) -> Fitted:
    """Train a model by name on the frame's rows; an unknown name is an error."""
    _fitter(kind)
    encoder = encoder or fit_encoder(frame, include_sensitive, drop_proxies)
    return _fitter(kind)(_training_rows(frame, encoder), encoder, name or kind, include_sensitive)


def fit_all(
    frame: AuditFrame, kinds: tuple[str, ...] = KINDS, include_sensitive: bool = True, drop_proxies: bool = False
) -> list[Fitted]:
    """Several kinds on one encoder; the encoded training rows are kept until all are trained."""
    fitters = [_fitter(k) for k in kinds]
    encoder = fit_encoder(frame, include_sensitive, drop_proxies)
    train = _training_rows(frame, encoder).persist()
    try:
        return [f(train, encoder, k, include_sensitive) for f, k in zip(fitters, kinds)]
    finally:
        train.unpersist()


def _fitter(kind: str):
    fitters = {"logreg": _fit_logreg, "tree": _fit_tree, "rulelist": _fit_rule_list}
    if kind not in fitters:
        raise ValueError(f"model must be one of {sorted(fitters)}, not {kind!r}")
    return fitters[kind]


def _training_rows(frame: AuditFrame, encoder: Encoder) -> DataFrame:
    labelled = frame.df.withColumn("_label", F.col(frame.label).cast("double")).filter("_label is not null")
    return assemble(labelled, encoder, ["_label"])


def _fit_logreg(train: DataFrame, encoder: Encoder, name: str, include_sensitive: bool) -> Fitted:
    """L2-penalised logistic regression with unit penalty strength on the summed loss.

    The learner keeps some twenty dense vectors of all weights on the driver. So where a dictionary column makes most of
    them, the same optimum is found with that column's weights as a table, and only the model holds them side by side.
    """
    widest = max(encoder.dictionaries, key=lambda b: b.size, default=None)
    if widest is not None and encoder.size - widest.size < profiled.SHARED:
        labels = [r["_label"] for r in train.groupBy("_label").count().limit(3).collect()]
        if sorted(labels) == [0.0, 1.0]:
            return _fit_wide(train, encoder, widest, name, include_sensitive)
    n = train.count()
    model = LogisticRegression(
        labelCol="_label",
        maxIter=500,
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-10,
    ).fit(train)
    found = model.coefficients.toArray()
    weights = {f.name: float(w) for f, w in zip(encoder.numeric, found)}
    tables = {}
    for block, at in zip(encoder.blocks, encoder.offsets()):
        own = found[at : at + block.size]
        if isinstance(block, CategoricalBlock):
            weights.update(zip(block.names(), map(float, own)))
            continue
        # the learner hands all coefficients to the driver; they go back by slot and never become expressions
        tables[block.source] = _by_value(block, _by_slot(train.sparkSession, own))
    return Fitted(model, LinearScorer(name, encoder, weights, float(model.intercept), include_sensitive, tables=tables), encoder)


def _by_slot(spark: SparkSession, weights) -> DataFrame:
    return spark.createDataFrame(pa.table({"slot": pa.array(range(len(weights)), pa.int64()), "weight": pa.array(weights, pa.float64())}))


def _by_value(block: DictionaryBlock, slots: DataFrame) -> DataFrame:
    return settle(block.table.join(slots, "slot", "left").select("value", F.coalesce("weight", F.lit(0.0)).alias("weight")))


def _fit_wide(train: DataFrame, encoder: Encoder, widest: DictionaryBlock, name: str, include_sensitive: bool) -> Fitted:
    offset = dict(zip([b.source for b in encoder.blocks], encoder.offsets()))[widest.source]
    intercept, others, slots = profiled.fit(train, "_label", offset, widest.size, encoder.size)
    weights = {f.name: float(w) for f, w in zip(encoder.numeric, others)}
    tables = {widest.source: _by_value(widest, slots)}
    for block, at in zip(encoder.blocks, encoder.offsets()):
        if block is widest:
            continue
        start = at - widest.size * (at > offset)
        own = others[start : start + block.size]
        if isinstance(block, CategoricalBlock):
            weights.update(zip(block.names(), map(float, own)))
        else:
            tables[block.source] = _by_value(block, _by_slot(train.sparkSession, own))
    model = _library_model(slots, intercept, others, offset, widest.size)
    return Fitted(model, LinearScorer(name, encoder, weights, intercept, include_sensitive, tables=tables), encoder)


@dataclass(frozen=True)
class ModelParts:
    """MLlib's model of a wide column by parts of it, each with the other features' weights and the intercept.

    A row has one entry of the wide column at most, so the model of its part sees all that the whole one would; neither
    the driver nor a task holds more than a part. ``path`` keeps a line (part, intercept, weights) for every part.
    """

    path: str
    spark: SparkSession
    parts: int
    at: int
    wide: int
    size: int

    def width(self, part: int) -> int:
        return self.size - self.wide + min(PART, self.wide - part * PART)

    def part(self, part: int) -> LogisticRegressionModel:
        """One part, by MLlib's own file format."""
        spark, size, path = self.spark, self.width(part), scratch_path(self.spark, "logreg")
        kinds = {"interceptVector": VectorUDT(), "coefficientMatrix": MatrixUDT()}
        schema = T.StructType([T.StructField(n, kinds.get(n, T._parse_datatype_string(t))) for n, t in MODEL_FIELDS.items()])
        spark.read.schema(schema).parquet(f"{self.path}/part={part}").write.parquet(f"{path}/data")
        learner = LogisticRegression(labelCol="_label")
        params = {p.name: v for p, v in learner.extractParamMap().items()}
        about = {
            "class": "org.apache.spark.ml.classification.LogisticRegressionModel",
            "timestamp": int(time.time() * 1000),
            "sparkVersion": spark.version,
            "uid": learner.uid,
            "paramMap": {"labelCol": "_label"},
            "defaultParamMap": params | {"labelCol": "label"},
        }
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        model = LogisticRegressionModel.load(path)
        if model.numFeatures != size:
            raise ValueError(f"part {part} has {model.numFeatures} features instead of {size}")
        return model

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Every row and its ``prediction``. The parts follow one another, each job with one part's weights."""
        keep = [c for c in vectors.columns if c != "features"]
        vector, end = F.unwrap_udt("features"), self.at + self.wide
        rows = vectors.select(*keep, vector["indices"].alias("_i"), vector["values"].alias("_v"))
        own = F.expr(f"element_at(filter(_i, e -> e >= {self.at} AND e < {end}), 1)")
        has = F.expr(f"exists(_i, e -> e >= {self.at} AND e < {end})")
        rows = rows.withColumn("_part", F.when(has, F.floor((own - self.at) / F.lit(PART))).otherwise(0).cast("int")).withColumn("_deal", F.rand(13))
        rows = rows.repartitionByRange(rows.count() // PART_ROWS + 1, "_part", "_deal")
        # features behind the wide column move up to the end of its part
        width = F.least(F.lit(PART), F.lit(self.wide) - F.col("_part") * PART)
        index = F.transform(
            "_i",
            lambda e: F.when(e < self.at, e).when(e < end, e - F.col("_part") * PART).otherwise(e - self.wide + width).cast("int"),
        )
        local = F.struct(
            F.lit(0).cast("byte").alias("type"), (width + (self.size - self.wide)).cast("int").alias("size"), index.alias("indices"), F.col("_v").alias("values")
        )
        path = scratch_path(self.spark, "parts")
        dealt = rows.select(*keep, "_part", local.alias("features"))
        dealt.write.partitionBy("_part").parquet(f"{path}/rows")
        there = {r["_part"] for r in self.spark.read.schema(dealt.schema).parquet(f"{path}/rows").select("_part").distinct().collect()}
        kept = T.StructType([dealt.schema[c] for c in keep])
        for part in sorted(there):
            found = self.spark.read.schema(T.StructType([*kept.fields, T.StructField("features", VectorUDT())])).parquet(f"{path}/rows/_part={part}")
            self.part(part).transform(found).select(*keep, "prediction").write.parquet(f"{path}/found/{part}")
        schema = T.StructType([*kept.fields, T.StructField("prediction", T.DoubleType())])
        return self.spark.read.schema(schema).parquet(*[f"{path}/found/{part}" for part in sorted(there)]) if there else self.spark.createDataFrame([], schema)


def _library_model(slots: DataFrame, intercept: float, others: np.ndarray, at: int, wide: int) -> LogisticRegressionModel | ModelParts:
    """MLlib's model of these weights; in parts if the wide column has more than ``PART`` of them."""
    spark, size, each = slots.sparkSession, len(others) + wide, PART
    parts = -(-wide // each)

    def line(table: pa.Table) -> pa.Table:
        part, slot, weight = table["part"][0].as_py(), table["slot"].to_numpy(), table["weight"].to_numpy()
        whole = np.zeros(min(each, wide - part * each))
        whole[slot[slot >= 0] - part * each] = weight[slot >= 0]
        whole = np.concatenate([others[:at], whole, others[at:]])
        values = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), pa.array(whole))
        return pa.table({"part": pa.array([part], pa.int64()), "weights": values})

    # every part has a line, and a place for slots without rows
    empty = spark.range(parts).select(F.col("id").alias("part"), F.lit(-1).cast("long").alias("slot"), F.lit(0.0).alias("weight"))
    lines = slots.select(F.floor(F.col("slot") / F.lit(each)).alias("part"), "slot", "weight").unionByName(empty)
    lines = lines.groupBy("part").applyInArrow(line, "part long, weights array<double>")
    plain_fields = lines.selectExpr(
        "part",
        "2 AS numClasses",
        "size(weights) AS numFeatures",
        f"named_struct('type', CAST(1 AS TINYINT), 'size', CAST(NULL AS INT), 'indices', CAST(NULL AS ARRAY<INT>), 'values', array({number(intercept)})) AS interceptVector",
        "named_struct('type', CAST(1 AS TINYINT), 'numRows', 1, 'numCols', size(weights), 'colPtrs', CAST(NULL AS ARRAY<INT>), "
        "'rowIndices', CAST(NULL AS ARRAY<INT>), 'values', weights, 'isTransposed', true) AS coefficientMatrix",
        "false AS isMultinomial",
    )
    path = scratch_path(spark, "weights")
    plain_fields.write.partitionBy("part").parquet(path)
    model = ModelParts(path, spark, parts, at, wide, size)
    return model.part(0) if parts == 1 else model


def _tree(train: DataFrame, depth: int) -> DecisionTreeClassificationModel:
    return DecisionTreeClassifier(labelCol="_label", maxDepth=depth, maxBins=MAX_BINS, seed=42).fit(train)


def _fit_tree(train: DataFrame, encoder: Encoder, name: str, include_sensitive: bool) -> Fitted:
    model = _tree(train, TREE_DEPTH)
    nodes = tree_nodes(train.sparkSession, model, encoder)
    return Fitted(model, TreeScorer(name, encoder, nodes, include_sensitive), encoder)


def _fit_rule_list(train: DataFrame, encoder: Encoder, name: str, include_sensitive: bool) -> Fitted:
    """A shallow tree whose paths, left first, become the ordered rules."""
    model = _tree(train, RULE_DEPTH)
    tree = TreeScorer(name, encoder, tree_nodes(train.sparkSession, model, encoder), include_sensitive)
    counts = {int(r["_label"]): r["n"] for r in train.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    default = 1 if counts.get(1, 0) > counts.get(0, 0) else 0
    return Fitted(model, rule_list_from_tree(tree, default), encoder)


def tree_nodes(spark, model: DecisionTreeClassificationModel, encoder: Encoder) -> tuple[Node, ...]:
    """The node table of a tree, read back from the saved model (2^(depth+1) − 1 rows at most)."""
    path = scratch_path(spark, "tree-model")
    model.save(path)
    saved = spark.read.parquet(f"{path}/data").orderBy("id").collect()
    names = encoder.names_at([r["split"]["featureIndex"] for r in saved if r["leftChild"] >= 0])
    nodes = []
    for r in saved:
        stats = list(r["impurityStats"])
        n0, n1 = float(stats[0]), float(stats[1]) if len(stats) > 1 else 0.0
        if r["leftChild"] < 0:
            nodes.append(Node(r["id"], n0=n0, n1=n1))
            continue
        split = r["split"]
        feature, threshold = names[split["featureIndex"]], split["leftCategoriesOrThreshold"]
        if split["numCategories"] != -1:
            raise ValueError(f"feature {feature} was trained as categorical; thresholds are expected")
        nodes.append(Node(r["id"], feature, float(threshold[0]), r["leftChild"], r["rightChild"], n0, n1))
    return tuple(nodes)


# ---------------------------------------------------------------------------------------------
# Is a fit what it should be? Relations that hold for the right model, whatever found it
# ---------------------------------------------------------------------------------------------


def logreg_gradient(fitted: Fitted, frame: AuditFrame) -> DataFrame:
    """``(feature, component)``: the gradient of the mean penalised loss at the fitted weights, zero at the optimum.

    One aggregate over the rows; the intercept carries no penalty.
    """
    encoder, scorer, n = fitted.encoder, fitted.scorer, F.count("*")
    out = scorer()
    error = F.expr(f"{out.proba_text} - CAST({plain(frame.label)} AS DOUBLE)")
    features = encoder.columns()
    wide = frame.df.select(error.alias("_e"), *[c.alias(f"_f{i}") for i, c in enumerate(features.values())]).agg(
        F.avg("_e").alias("_i"), n.alias("_n"), *[F.avg(F.col("_e") * F.col(f"_f{i}")).alias(f"_g{i}") for i in range(len(features))]
    )
    lines = [F.struct(F.lit("(intercept)").alias("feature"), F.col("_i").alias("component"))]
    for i, name in enumerate(features):
        penalty = F.lit(float(scorer.weights.get(name, 0.0))) / F.col("_n")
        lines.append(F.struct(F.lit(name).alias("feature"), (F.col(f"_g{i}") + penalty).alias("component")))
    return wide.select(F.inline(F.array(*lines)))


def rule_counts(scorer: TreeScorer | RuleListScorer, frame: AuditFrame) -> DataFrame:
    """``(rule_no, depth, pred, proba, n0, n1)``: every leaf or rule as it is stated, with the rows that reach it first.

    Rows that no rule takes are counted under number −1. One aggregate over the rows.
    """
    rules = scorer.rules() if isinstance(scorer, TreeScorer) else scorer.rules
    branches = " ".join(f"WHEN {all_of(scorer.encoder, r.conditions)} THEN {i}" for i, r in enumerate(rules))
    number = F.expr(f"CASE {branches} ELSE -1 END") if rules else F.lit(-1)
    y = F.col(frame.label)
    seen = frame.df.groupBy(number.alias("rule_no")).agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    stated = frame.df.sparkSession.createDataFrame(
        [(i, len(r.conditions), int(r.pred), float(r.proba)) for i, r in enumerate(rules)], "rule_no int, depth int, pred int, proba double"
    )
    return stated.join(seen, "rule_no", "full").fillna(0, ["n0", "n1"])


def rule_mismatches(counts: DataFrame) -> DataFrame:
    """Rules of :func:`rule_counts` whose class or probability is not that of their rows; a tie is class 0."""
    share = F.try_divide(F.col("n1").cast("double"), (F.col("n0") + F.col("n1")).cast("double"))
    right = (F.col("pred") == (F.col("n1") > F.col("n0")).cast("int")) & (F.abs(F.col("proba") - share) < 1e-9)
    return counts.filter(~F.coalesce(right, F.lit(False)))
