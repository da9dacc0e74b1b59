"""Helpers that several operators share: intermediate tables, safe columns, batches of documents."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. A local one is made only for a local master without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back. The new path is added to `paths`."""
    spark = df.sparkSession
    release(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def remainder(id_column: str = "doc_id", by: int = 5) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "utf-8")), F.lit(by))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets into them, without copying."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1]
    at = at.astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole[:0], at - (at[0] if len(at) else 0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of text, or one longer document."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
