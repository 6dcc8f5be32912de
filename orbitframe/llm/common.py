"""What the operators of this package share: tables, scratch folders, Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orbitframe.sources.landing import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the folder that all executors share."""
    return f"{shared_folder(spark)}/orbitframe-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str | None = None, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: it survives lost executors."""
    folder = folder or scratch(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    for value in column.cast(pa.binary()).to_pylist():
        yield value or b""


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def release() -> None:
    """Give freed memory back to the system: idle Python workers keep theirs beside the running ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
