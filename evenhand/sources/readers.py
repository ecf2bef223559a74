"""Scans. Spark itself raises for a missing path, so an absent input never reads as an empty table; input that
does not fit its schema raises as well, unless a reader is told to be permissive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions.groups import group_from_codes
from evenhand.functions.text import equals_label, strip_character
from evenhand.operators.clean import drop_columns


STRICT = "FAILFAST"


def read_csv(spark: SparkSession, path: str | list[str], schema=None, mode: str = STRICT) -> DataFrame:
    """CSV with a header line. Types are inferred (a second scan) only without a schema."""
    reader = spark.read.option("header", True).option("mode", mode)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_headerless_csv(
    spark: SparkSession, path: str | list[str], schema, missing: str = "?", comment: str | None = "|", mode: str = STRICT
) -> DataFrame:
    """CSV without header: given names, blanks after commas skipped, a token for missing values and
    a comment sign whose lines are dropped."""
    reader = (
        spark.read.schema(schema)
        .option("header", False)
        .option("mode", mode)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", missing)
    )
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def read_blank_separated(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Columns separated by runs of blanks. A short line gives NULLs at its end; a field that is not of
    its column's type raises."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    fields = F.split(F.trim(F.col("value")), r"\s+")
    columns = []
    for i, f in enumerate(schema.fields):
        raw = F.get(fields, F.lit(i))
        cast = raw.try_cast(f.dataType)
        wrong = F.raise_error(F.concat(F.lit(f"column {f.name} cannot hold "), raw)).cast(f.dataType)
        columns.append(F.when(raw.isNull() | cast.isNotNull(), cast).otherwise(wrong).alias(f.name))
    return spark.read.text(path).filter(F.trim("value") != "").select(*columns)


PAIR_CHECK = (
    "struct<source_group:string,target_group:string,status:string,score_x:string,score_y:string,"
    "prediction_x:string,prediction_y:string,example_x:map<string,string>,example_y:map<string,string>>"
)
PAIR_DOCUMENT = (
    "dataset string, model string, sensitive_attribute string, encoding_scope string, fairness_property string, "
    f"overall_status string, pair_checks array<{PAIR_CHECK}>, first_counterexample {PAIR_CHECK}, "
    "runtime_seconds double, timeout boolean, ce_bound bigint, ce_found bigint, kind string, num_rules int, "
    "tree_max_depth int, rulelist_max_depth int, logreg_intercept double, n_train_rows bigint, n_test_rows bigint"
)


def read_documents(spark: SparkSession, path: str | list[str], schema: str | T.StructType = PAIR_DOCUMENT, lines: bool = False, mode: str = STRICT) -> DataFrame:
    """JSON documents, one per file (or one per line); a broken one raises. Numbers and strings may mix
    inside examples; the bare token ``NaN`` that some writers emit is read where the schema says text or
    number, and the text ``NaN`` of a top-level column means a missing value."""
    reader = spark.read.schema(schema).option("multiLine", not lines).option("allowNonNumericNumbers", True)
    found = reader.option("mode", mode).json(path)
    return nan_to_null(found, [f.name for f in found.schema.fields if isinstance(f.dataType, T.StringType)])


def explode_pairs(documents: DataFrame) -> DataFrame:
    """One row per checked pair."""
    return documents.select("dataset", "model", "sensitive_attribute", F.explode("pair_checks").alias("p")).select(
        "dataset", "model", "sensitive_attribute", "p.*"
    )


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """The text ``nan`` stands for a missing value."""
    return df.withColumns({c: F.when(F.lower(F.col(c)) != "nan", F.col(c)) for c in columns}) if columns else df


def read_tagged(spark: SparkSession, files: dict[str, dict[str, str]], schema=None) -> DataFrame:
    """CSV files with a header into one table, each file with constant tag columns.

    A tag fills a column the file lacks, or adds one; a column the file already has keeps its
    values. Files may differ in their columns.
    """
    parts = []
    for path, tags in files.items():
        part = read_csv(spark, path, schema)
        for name, value in tags.items():
            if name not in part.columns:
                part = part.withColumn(name, F.lit(value))
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_tagged_folder(spark: SparkSession, paths: list[str], tags: dict[str, dict[str, str]], schema) -> DataFrame:
    """Many equally shaped CSV files in one scan, tagged by path.

    The tag table has one row per known file, named by as much of the end of its path as tells it from
    the others (``run1/summary.csv``). A file that no name or more than one name fits is an error at run
    time, not a silent NULL.
    """
    names = sorted({t for v in tags.values() for t in v})
    parts = {f: f.strip("/").split("/") for f in tags}
    rows = [(len(p), "/".join(p), *[tags[f].get(n) for n in names]) for f, p in parts.items()]
    columns = [f"_t{i}" for i in range(len(names))]
    known = spark.createDataFrame(rows, ", ".join(["_depth int", "_name string", *[f"{c} string" for c in columns]]))
    pieces = F.split(F.col("_metadata.file_path"), "/")
    scan = read_csv(spark, paths, schema).select("*", F.col("_metadata.file_path").alias("_path"), pieces.alias("_parts"))
    # a name is the last so many parts of a path: one key per length that names have, met by a hash join
    depths = sorted({len(p) for p in parts.values()})
    keys = ", ".join(
        f"named_struct('_depth', {d}, '_name', array_join(slice(_parts, greatest(size(_parts) - {d - 1}, 1), {d}), '/'))" for d in depths
    )
    own = scan.select("_path", F.expr(f"inline(array({keys}))")).distinct()
    fitting = own.join(F.broadcast(known), ["_depth", "_name"]).groupBy("_path").agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns]
    )
    tagged = scan.join(F.broadcast(fitting), "_path", "left")  # a line per file
    found = F.coalesce("_n", F.lit(0))
    guarded = F.when(found == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(found.cast("string"), F.lit(" tags for file "), F.col("_path"))).cast("boolean")
    )
    data = [c for c in scan.columns if c not in ("_path", "_parts")]
    return tagged.filter(guarded).select(*data, *[F.col(c).alias(n) for c, n in zip(columns, names)])


# Column names and types of the three public audit data sets, in file order.
ADULT_SCHEMA = (
    "age int, workclass string, fnlwgt int, education string, education_num int, marital_status string, "
    "occupation string, relationship string, race string, sex string, capital_gain int, capital_loss int, "
    "hours_per_week int, native_country string, income string"
)
GERMAN_SCHEMA = (
    "status_checking string, duration_months int, credit_history string, purpose string, credit_amount int, "
    "savings string, employment_since string, installment_rate int, personal_status_sex string, "
    "other_debtors string, present_residence_since int, property string, age_years int, "
    "other_installment_plans string, housing string, existing_credits int, job string, people_liable int, "
    "telephone string, foreign_worker string, class int"
)
GERMAN_SEX_CODES = {"male": ["A91", "A93", "A94"], "female": ["A92", "A95"]}


def load_adult(spark: SparkSession, train_path: str, test_path: str) -> DataFrame:
    """Both files as one table with a ``split`` column; the label loses its trailing dot and rows
    without one are dropped."""
    train = read_headerless_csv(spark, train_path, ADULT_SCHEMA).withColumn("split", F.lit("train"))
    test = read_headerless_csv(spark, test_path, ADULT_SCHEMA).withColumn("split", F.lit("test"))
    both = train.unionByName(test).withColumn("income", strip_character(F.col("income"), "."))
    return both.dropna(subset=["income"]).withColumn("label", equals_label(F.col("income"), ">50K")).drop("income")


def load_german(spark: SparkSession, path: str) -> DataFrame:
    """Credit table with the sex derived from its status code; the code column stays a feature."""
    df = read_blank_separated(spark, path, GERMAN_SCHEMA)
    return (
        df.withColumn("sex", group_from_codes(F.col("personal_status_sex"), GERMAN_SEX_CODES))
        .withColumn("label", equals_label(F.col("class"), 1))
        .drop("class")
    )


def load_scholarship(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Scholarship table: label from the eligibility text, the amount column dropped as leakage."""
    df = read_csv(spark, path, schema)
    labelled = df.withColumn("label", equals_label(F.col("Status_Kelayakan"), "Layak"))
    return drop_columns(labelled, "Status_Kelayakan", ("Jumlah_Beasiswa_Per_Semester",))
