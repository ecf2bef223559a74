"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.session import scratch_path, shared_folder, shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file on this machine: an absolute path as it is, else a public file's name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and kept in the shared folder; lost executors cost no recomputation."""
    spark = df.sparkSession
    shipped(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage of an iterated table."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, rows: int, at_once: int = 100_000) -> DataFrame:
    """As many partitions as so many rows need, and no more than there are: a small table makes no host of tasks."""
    return df.coalesce(rows // at_once + 1)


def held_out(doc_id: str, modulus: int, remainder: int = 2):
    """crc32 of the id's decimal text, as the fold of a document; a null id counts as the text ``null``."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return (F.crc32(text) % modulus) == remainder


def shielded(docs: DataFrame, internal: set[str], work) -> DataFrame:
    """``work(docs)`` with the columns that are named like ``internal`` ones out of its way, and back in the result."""
    own = {c: f"own{i}_{uuid.uuid4().hex}" for i, c in enumerate(docs.columns) if c in internal}
    if not own:
        return work(docs)
    return work(docs.withColumnsRenamed(own)).withColumnsRenamed({v: k for k, v in own.items()})
