"""Readers, scratch tables and Arrow helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import scratch_path

#: Runs of everything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, so a lost executor costs
    no recomputation, and later steps read only the columns they use."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, key: str, buckets: int, **options) -> DataFrame:
    """As ``stored``, in buckets of a key: a join on that key reads this side in place and shuffles only the other. The table is
    known to the session's catalog only while it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = "stored_" + uuid.uuid4().hex
    df.write.options(path=path, **options).bucketBy(buckets, key).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the name goes; the files stay
    spark.sql(f"drop table {name}")
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver's collectors see plans that are no longer used, so that their shuffle files go before the next
    step of a long job writes its own. A plan is let go in stages, so one collection is not enough."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Send Python workers at most so many rows at once while the block runs. By default whole splits of texts are one batch, which the executor
    and the worker both hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if not 0 < int(before or 0) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front while the input has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return body, at.astype(np.int64) - int(at[0])


def texts_of(batch: pa.RecordBatch, text: str = "text") -> Iterator[str | None]:
    """The texts of a batch one after the other, so that only one is held as an object."""
    return (value.as_py() for value in batch.column(batch.schema.get_field_index(text)))


def pieces(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text each (one row at least), so that the memory
    of a vectorised step follows the longest text and not the size of the batch."""
    if batch.num_rows == 0:
        return
    _, at = text_array(batch.column(batch.schema.get_field_index(text)))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + most_bytes, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of consecutive runs, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - sizes - starts, sizes)
