"""Sinks. Output is written by the tasks that hold it; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with header. Maps, structs and arrays become JSON text, which CSV cannot hold otherwise."""
    nested = (T.MapType, T.StructType, T.ArrayType)
    flat = [
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def run_record(df: DataFrame, run_id: str, run_ts: str | None = None, values: list[str] | None = None) -> DataFrame:
    """A summary table as ``(run_id, run_ts, entry, key, value)`` rows, one per cell.

    ``run_id`` names a column that identifies the run of a row; ``run_ts`` is fixed for tests and
    the current time otherwise.
    """
    cells = values or [c for c in df.columns if c != run_id]
    stamp = F.lit(run_ts).cast("timestamp") if run_ts else F.current_timestamp()
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), _text(df, c).alias("value")) for c in cells])
    return df.select(F.col(run_id).cast("string").alias("run_id"), stamp.alias("run_ts"), F.inline(pairs))


def _text(df: DataFrame, column: str):
    nested = (T.MapType, T.StructType, T.ArrayType)
    return F.to_json(column) if isinstance(df.schema[column].dataType, nested) else F.col(column).cast("string")


def append_run(records: DataFrame, path: str) -> None:
    """Append run records, partitioned by day."""
    dated = records.withColumn("run_date", F.to_date("run_ts"))
    write_table(dated, path, ["run_date"], mode="append")
