"""CSV and Parquet sources and sinks for flows, traces and HTTP traces."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtrace.schema import FAMILY_ALIASES

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    try:
        base = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001  (Spark Connect: read the setting)
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("no spark.checkpoint.dir set; it names the shared folder for written tables")
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Quoted CSV with a header (values with commas stay in one field)."""
    w = df.write.mode(mode).options(**CSV_OPTIONS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, with_file: bool = False) -> DataFrame:
    """CSV with a header and a given schema (no inference pass over the data)."""
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    if with_file:
        df = df.withColumn("file_name", F.col("_metadata.file_name"))
    return df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_trace_tables(spark: SparkSession, path: str, schema: T.StructType, partition_col: str | None = "File",
                      fmt: str = "csv") -> DataFrame:
    """Trace tables written one folder per capture file (``File=<name>``).

    The capture's file name comes back as a column, from the folder name
    (partition discovery; filters on it prune folders).
    """
    if fmt == "csv":
        full = schema if partition_col is None else T.StructType(schema.fields + [T.StructField(partition_col, T.StringType())])
        return spark.read.options(**CSV_OPTIONS).schema(full).csv(path)
    return spark.read.parquet(path)


def normalise_family(df: DataFrame, col: str = "Family") -> DataFrame:
    """Map spelling variants of family names to one spelling."""
    expr = F.col(col)
    for bad, good in FAMILY_ALIASES.items():
        expr = F.when(F.col(col) == bad, F.lit(good)).otherwise(expr)
    return df.withColumn(col, expr)


def reference_csv_layout(df: DataFrame) -> DataFrame:
    """Drop the unnamed leading index column that pandas writes (``_c0``)."""
    return df.drop("_c0") if "_c0" in df.columns else df
