"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts name it: space and code points 9 to 13.
ASCII_SPACE = " \t\n\x0b\f\r"

#: Rows in an Arrow batch of whole texts.  Small, because one row can be long.
TEXT_BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark (the folder may be in a store only Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in small batches, so that a batch of long texts fits in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, binary: bool = False) -> DataFrame:
    """The two columns an operator needs, null text as empty; other columns are left out here."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), (text.cast("binary") if binary else text).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], added: str) -> DataFrame:
    """``df`` with the columns named in the DDL text ``added``, which ``fn`` makes of each Arrow batch.

    The columns of ``df`` pass through; an added column replaces one of its name.
    """
    new = T.StructType.fromDDL(added)
    schema = T.StructType([f for f in df.schema if f.name not in new.names] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [made[n] if n in made else batch.column(n) for n in schema.names], names=schema.names)

    return df.mapInArrow(run, schema)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    A reliable checkpoint: the rows outlive any executor.  The folder is that of
    ``spark.checkpoint.dir`` (set for the session by its owner).
    """
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it from there.

    Unlike a checkpoint it is compressed, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
