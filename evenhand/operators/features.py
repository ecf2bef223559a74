"""Imputation, scaling, one-hot encoding and the feature schema.

Fitting reads the training rows in a fixed number of aggregate jobs. A categorical column with few
categories becomes expressions: its category list comes to the driver, and applying it is a projection
inside the scan stage. One with many becomes a dictionary: a table (value, slot), numbered by range, that
never passes the driver; rows meet it, or the weights of a model by slot, in a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.frame import AuditFrame
from evenhand.functions.expressions import Lookup, literal, number, plain
from evenhand.operators.ranks import dense_index, exact_medians
from evenhand.session import scratch_path, settle

#: Categories of a column up to which it is written as expressions; beyond, it is joined. Results are the same.
INLINE_CATEGORIES = 256


@dataclass(frozen=True)
class NumericFeature:
    source: str
    median: float | None = None
    mean: float = 0.0
    scale: float = 1.0

    @property
    def name(self) -> str:
        return self.source

    def text(self, lookup: Lookup = plain) -> str:
        raw = f"CAST({lookup(self.source)} AS DOUBLE)"
        if self.median is not None:
            raw = f"coalesce({raw}, {number(self.median)})"
        if self.mean == 0.0 and self.scale == 1.0:
            return raw
        return f"(({raw} - {number(self.mean)}) / {number(self.scale)})"


@dataclass(frozen=True)
class CategoricalBlock:
    source: str
    categories: tuple[str, ...]
    mode: str | None = None

    def value(self, lookup: Lookup = plain) -> str:
        raw = f"CAST({lookup(self.source)} AS STRING)"
        return raw if self.mode is None else f"coalesce({raw}, {literal(self.mode)})"

    @property
    def size(self) -> int:
        return len(self.categories)

    def names(self) -> list[str]:
        return [f"{self.source}={c}" for c in self.categories]

    def slot(self, lookup: Lookup = plain) -> str:
        """The number of the row's category, NULL for an unseen or missing one."""
        listed = ", ".join(literal(c) for c in self.categories)
        place = f"array_position(array({listed}), {self.value(lookup)})" if self.categories else "CAST(NULL AS BIGINT)"
        return f"nullif({place} - 1, -1)"

    def indicator(self, category: str, lookup: Lookup = plain) -> str:
        """1.0 for the category and 0.0 for anything else, an unseen or missing value included."""
        return f"CASE WHEN {self.value(lookup)} = {literal(category)} THEN 1D ELSE 0D END"


@dataclass(frozen=True)
class DictionaryBlock:
    """A categorical column as a table ``(value, slot)`` with slots 0…size−1 in the order of the values."""

    source: str
    table: DataFrame
    size: int
    mode: str | None = None

    value = CategoricalBlock.value
    indicator = CategoricalBlock.indicator

    @property
    def slot_column(self) -> str:
        return f"_slot_{self.source}"

    def slot(self, lookup: Lookup = plain) -> str:
        return plain(self.slot_column)

    def joined(self, df: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
        """Every row with the ``column`` that ``table`` has for its value, NULL for an unseen or missing one.

        The optimiser broadcasts a table that is small; beyond that rows are shuffled by the value, and AQE
        splits a value that many rows share.
        """
        entries = table.select(F.col("value").alias("_value"), F.col(column).alias(name))
        return df.join(entries, F.expr(self.value()) == F.col("_value"), "left").drop("_value")


@dataclass(frozen=True)
class Encoder:
    """Ordered model inputs: numeric features first, then one block per categorical column."""

    numeric: tuple[NumericFeature, ...] = ()
    blocks: tuple[CategoricalBlock | DictionaryBlock, ...] = ()
    _index: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def dictionaries(self) -> list[DictionaryBlock]:
        return [b for b in self.blocks if isinstance(b, DictionaryBlock)]

    def inline(self) -> Encoder:
        """The same without its dictionary columns."""
        return Encoder(self.numeric, tuple(b for b in self.blocks if isinstance(b, CategoricalBlock)))

    @property
    def size(self) -> int:
        return len(self.numeric) + sum(b.size for b in self.blocks)

    def offsets(self) -> list[int]:
        """The position of the first feature of every block."""
        out, at = [], len(self.numeric)
        for b in self.blocks:
            out.append(at)
            at += b.size
        return out

    def names(self) -> list[str]:
        """All features in order; an encoder with dictionary columns has them as a table only."""
        if self.dictionaries:
            raise ValueError(f"the features of {[b.source for b in self.dictionaries]} are a table: see schema_table")
        return [f.name for f in self.numeric] + [n for b in self.blocks for n in b.names()]

    def names_at(self, positions: list[int]) -> dict[int, str]:
        """The names of a few features, as those a tree splits on."""
        out = {i: f.name for i, f in enumerate(self.numeric)}
        for b, at in zip(self.blocks, self.offsets()):
            if isinstance(b, CategoricalBlock):
                out.update(zip(range(at, at + b.size), b.names()))
                continue
            slots = [p - at for p in positions if at <= p < at + b.size]
            found = b.table.filter(F.col("slot").isin(slots)).collect() if slots else []  # one row per position asked for
            out.update({r["slot"] + at: f"{b.source}={r['value']}" for r in found})
        return {p: out[p] for p in positions}

    def _owners(self) -> dict:
        if not self._index:
            self._index.update({f.name: (f, None) for f in self.numeric})
            for b in self.blocks:
                if isinstance(b, CategoricalBlock):
                    self._index.update({f"{b.source}={c}": (b, c) for c in b.categories})
        return self._index

    def _owner(self, feature: str) -> tuple:
        """The part that a feature belongs to and its category; any value of a dictionary column is a feature."""
        if feature in self._owners():
            return self._owners()[feature]
        return next(((b, feature[len(b.source) + 1 :]) for b in self.dictionaries if feature.startswith(f"{b.source}=")), (None, None))

    def text(self, feature: str, lookup: Lookup = plain) -> str:
        """The expression of one feature."""
        owner, category = self._owner(feature)
        if owner is None:
            raise ValueError(f"unknown feature {feature!r}")
        return owner.text(lookup) if category is None else owner.indicator(category, lookup)

    def condition(self, feature: str, op: str, threshold: float, lookup: Lookup = plain) -> str:
        """``feature <= threshold`` or ``feature > threshold``.

        A test of a 0/1 column is written as a test of its category, which folds away when the
        column is pinned to a group.
        """
        owner, category = self._owner(feature)
        if category is not None and 0.0 <= threshold < 1.0:
            hit = f"{owner.value(lookup)} <=> {literal(category)}"
            return f"({hit})" if op == ">" else f"(NOT ({hit}))"
        return f"({self.text(feature, lookup)} {'<=' if op == '<=' else '>'} {number(threshold)})"

    def columns(self, lookup: Lookup = plain) -> dict[str, Column]:
        return {n: F.expr(self.text(n, lookup)) for n in self.names()}

    def with_slots(self, df: DataFrame) -> DataFrame:
        """The rows with a slot column for every dictionary column."""
        for b in self.dictionaries:
            df = b.joined(df, b.table, "slot", b.slot_column)
        return df

    def vectors(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Kept columns plus ``features``, a sparse vector: the numeric features and one entry per category that is set.

        The vector's fields are computed as plain columns, written, and read back as a vector: no row passes Python,
        and the learner that reads them many times finds them ready.
        """
        rows = self.with_slots(df)
        places = [f"named_struct('i', {i}, 'v', {f.text()})" for i, f in enumerate(self.numeric)]
        places += [f"named_struct('i', CAST({b.slot()} + {at} AS INT), 'v', 1D)" for b, at in zip(self.blocks, self.offsets())]
        entries = f"filter(array({', '.join(places)}), e -> e.i IS NOT NULL)"
        vector = (
            f"named_struct('type', CAST(0 AS TINYINT), 'size', {self.size}, 'indices', transform(_entries, e -> e.i), "
            "'values', transform(_entries, e -> e.v))"
        )
        plain_rows = rows.select(*keep, F.expr(entries).alias("_entries")).select(*keep, F.expr(vector).alias("features"))
        path = scratch_path(df.sparkSession, "vectors")
        plain_rows.write.parquet(path)
        schema = T.StructType([*plain_rows.schema.fields[:-1], T.StructField("features", VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(path)

    def block(self, source: str) -> CategoricalBlock | DictionaryBlock | None:
        return next((b for b in self.blocks if b.source == source), None)

    def without(self, source: str) -> Encoder:
        return Encoder(
            tuple(f for f in self.numeric if f.source != source), tuple(b for b in self.blocks if b.source != source)
        )

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Kept columns plus every feature as a plain double column; a dictionary column as its slot."""
        inline = self.inline()
        slots = [F.col(b.slot_column) for b in self.dictionaries]
        return self.with_slots(df).select(*keep, *[c.alias(n) for n, c in inline.columns().items()], *slots)

    def schema_table(self, spark: SparkSession) -> DataFrame:
        """``(position, feature, kind, source_col, category, median, mode, mean, scale)``."""
        rows = [
            (i, f.name, "numeric", f.source, None, f.median, None, float(f.mean), float(f.scale)) for i, f in enumerate(self.numeric)
        ]
        for b, at in zip(self.blocks, self.offsets()):
            if isinstance(b, CategoricalBlock):
                rows += [(at + i, n, "onehot", b.source, c, None, b.mode, None, None) for i, (c, n) in enumerate(zip(b.categories, b.names()))]
        out = spark.createDataFrame(
            rows,
            "position int, feature string, kind string, source_col string, category string, "
            "median double, mode string, mean double, scale double",
        )
        none = F.lit(None).cast("double")
        for b, at in zip(self.blocks, self.offsets()):
            if isinstance(b, DictionaryBlock):
                out = out.unionByName(
                    b.table.select(
                        (F.col("slot") + at).cast("int").alias("position"), F.concat(F.lit(f"{b.source}="), F.col("value")).alias("feature"),
                        F.lit("onehot").alias("kind"), F.lit(b.source).alias("source_col"), F.col("value").alias("category"),
                        none.alias("median"), F.lit(b.mode).cast("string").alias("mode"), none.alias("mean"), none.alias("scale"),
                    )
                )
        return out

    def bounds_table(self, df: DataFrame) -> DataFrame:
        """Min and max of every transformed feature: ``(feature, lo, hi)``. One pass, and one more per dictionary
        column, whose values are counted: a feature's least value is 1 if all rows have the value."""
        if self.dictionaries:
            inline = self.inline()
            out = inline.bounds_table(df) if inline.size else None
            for b in self.dictionaries:
                counts = df.groupBy(F.expr(b.value()).alias("value")).agg(F.count("*").alias("n"))
                total = df.agg(F.count("*").alias("n")).scalar()
                part = b.table.join(counts, "value", "left").select(
                    F.concat(F.lit(f"{b.source}="), F.col("value")).alias("feature"),
                    F.when(F.col("n") == total, 1.0).otherwise(0.0).alias("lo"),
                    F.when(F.col("n").isNotNull(), 1.0).otherwise(0.0).alias("hi"),
                )
                out = part if out is None else out.unionByName(part)
            return out
        features = self.columns()
        wide = df.agg(
            *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(features.values())],
            *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(features.values())],
        )
        rows = F.array(
            *[
                F.struct(F.lit(n).alias("feature"), F.col(f"lo_{i}").alias("lo"), F.col(f"hi_{i}").alias("hi"))
                for i, n in enumerate(features)
            ]
        )
        return wide.select(F.inline(rows))

    def decode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Back from feature columns to source values: ``z*scale+mean``, and the category whose
        0/1 column is 1 (NULL if none is). A dictionary column is read from its slot column."""
        for b in self.dictionaries:
            entries = b.table.select(F.col("value").alias(f"_from_{b.source}"), F.col("slot").alias(b.slot_column))
            df = df.join(entries, b.slot_column, "left")
        out = [(F.col(_q(f.name)) * F.lit(float(f.scale)) + F.lit(float(f.mean))).alias(f.source) for f in self.numeric]
        for b in self.blocks:
            if isinstance(b, DictionaryBlock):
                out.append(F.col(f"_from_{b.source}").alias(b.source))
                continue
            value = F.coalesce(*[F.when(F.col(_q(n)) == 1.0, F.lit(c)) for n, c in zip(b.names(), b.categories)])
            out.append(value.alias(b.source))
        return df.select(*keep, *out)


def _q(name: str) -> str:
    return f"`{name}`"


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(source_col, value, n)`` for all columns in one partially aggregated job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("source_col"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs)).filter("value is not null").groupBy("source_col", "value").agg(F.count("*").alias("n"))
    )


def most_frequent(counts: DataFrame) -> DataFrame:
    """Most frequent value per column, the smallest one of a tie."""
    return counts.groupBy("source_col").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))["value"].alias("mode")
    )


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: values, missing, mean, population deviation, min, max."""
    wide = df.agg(
        *[a for i, c in enumerate(columns) for a in (
            F.count(c).alias(f"n_{i}"),
            F.sum(F.col(c).isNull().cast("bigint")).alias(f"miss_{i}"),
            F.avg(c).alias(f"mean_{i}"),
            F.stddev_pop(c).alias(f"dev_{i}"),
            F.min(F.col(c).cast("double")).alias(f"lo_{i}"),
            F.max(F.col(c).cast("double")).alias(f"hi_{i}"),
        )]
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("source_col"),
            F.col(f"n_{i}").alias("n"),
            F.coalesce(F.col(f"miss_{i}"), F.lit(0)).alias("missing"),
            F.col(f"mean_{i}").alias("mean"),
            F.col(f"dev_{i}").alias("deviation"),
            F.col(f"lo_{i}").alias("lo"),
            F.col(f"hi_{i}").alias("hi"),
        )
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(rows))


def fit_encoder(
    frame: AuditFrame,
    include_sensitive: bool = True,
    drop_proxies: bool = False,
    train: DataFrame | None = None,
    inline: int = INLINE_CATEGORIES,
) -> Encoder:
    """Learn medians, modes, means, deviations and category lists from the training rows.

    A column with more than ``inline`` values becomes a dictionary; the sensitive column never does, because a row is
    scored once in every group.
    """
    df = frame.df if train is None else train
    numeric, categorical = frame.features(include_sensitive, drop_proxies)
    features: list[NumericFeature] = []
    if numeric:
        stats = {r["source_col"]: r for r in numeric_summary(df, numeric).collect()}
        medians = exact_medians(df, numeric, {c: stats[c]["n"] for c in numeric})
        for c in numeric:
            n, missing = stats[c]["n"], stats[c]["missing"]
            if n == 0:
                raise ValueError(f"numeric column {c} has no values")
            # moments after filling the gaps with the median, from the moments before
            total, m = n + missing, medians[c]
            mean = (n * stats[c]["mean"] + missing * m) / total
            spread = n * (stats[c]["deviation"] ** 2 + (stats[c]["mean"] - mean) ** 2) + missing * (m - mean) ** 2
            scale = (spread / total) ** 0.5
            features.append(NumericFeature(c, m, mean, scale if scale else 1.0))
    blocks: list[CategoricalBlock] = []
    if categorical:
        counts = category_counts(df, categorical)
        listed = counts.limit(inline * len(categorical) + 1).collect()
        by_column: dict[str, list] = {c: [] for c in categorical}
        for r in listed:
            by_column[r["source_col"]].append((r["value"], r["n"]))
        if len(listed) > inline * len(categorical) or any(len(v) > inline for c, v in by_column.items() if c != frame.sensitive):
            blocks = _dictionary_blocks(settle(counts), categorical, frame.sensitive, inline)
        else:
            blocks = [_inline_block(c, by_column[c]) for c in categorical]
    return Encoder(tuple(features), tuple(blocks))


def _inline_block(source: str, counted: list[tuple[str, int]]) -> CategoricalBlock:
    mode = min(counted, key=lambda vn: (-vn[1], vn[0]))[0] if counted else None
    return CategoricalBlock(source, tuple(sorted(v for v, _ in counted)), mode)


def _dictionary_blocks(counts: DataFrame, columns: list[str], sensitive: str, inline: int) -> list:
    """Blocks of columns of which some are too wide for expressions; ``counts`` is :func:`category_counts`, settled."""
    sizes = counts.groupBy("source_col").agg(F.count("*").alias("n"))
    heads = {r["source_col"]: r for r in sizes.join(most_frequent(counts), "source_col").collect()}  # one row per column
    wide = [c for c in columns if c != sensitive and c in heads and heads[c]["n"] > inline]
    narrow = [c for c in columns if c not in wide]
    lists: dict[str, list] = {c: [] for c in narrow}
    for r in counts.filter(F.col("source_col").isin(narrow)).collect() if narrow else []:
        lists[r["source_col"]].append((r["value"], r["n"]))
    numbered = settle(dense_index(counts.filter(F.col("source_col").isin(wide)).select("source_col", "value"), ["source_col", "value"], "slot"))
    starts, at = {}, 0
    for c in sorted(wide):  # the numbers run on from column to column
        starts[c] = at
        at += heads[c]["n"]
    out = []
    for c in columns:
        if c in wide:
            table = numbered.filter(F.col("source_col") == c).select("value", (F.col("slot") - starts[c]).alias("slot"))
            out.append(DictionaryBlock(c, table, heads[c]["n"], heads[c]["mode"]))
        else:
            out.append(_inline_block(c, lists[c]))
    return out
