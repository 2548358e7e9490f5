"""A log of records with an index of each file's offsets and times, so that a replay opens the files of its range and no others.

A micro-batch is dealt by range of the offset into files and sorted there, so files cover narrow, disjoint ranges whatever the size of the micro-batch. Its
index is one row per file: the smallest and largest offset and time, and the rows. Data and index have a folder per micro-batch, which a repeated one
overwrites; the index is written last and names what is read, so a half-written micro-batch is not seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import child_names, delete_path, path_exists
from orderflow.streaming.sinks import batch_path

ROWS_A_FILE = 1_000_000


def indexed_log(root: str, offset: str, ts: str, rows_a_file: int = ROWS_A_FILE) -> Callable[[DataFrame, int], None]:
    """The sink of a stream of records; ``offset`` is any ordered column, ``ts`` a timestamp. Rows without an offset or a time are kept: they are part of a
    replay that has no bounds in that column."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        data, index = batch_path(f"{root}/data", batch_id), batch_path(f"{root}/index", batch_id)
        delete_path(spark, index)
        rows = batch.count()
        if rows == 0:
            return
        dealt = batch.repartitionByRange(-(-rows // rows_a_file), offset).sortWithinPartitions(offset)
        dealt.write.mode("overwrite").parquet(data)
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        ranges = spark.read.schema(batch.schema).parquet(data).groupBy(name.alias("file")).agg(
            F.min(offset).alias("first_offset"), F.max(offset).alias("last_offset"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"),
        )
        ranges.coalesce(1).write.parquet(index)

    return write


def read_index(spark: SparkSession, root: str) -> DataFrame | None:
    """``batch_id, file, first_offset, last_offset, first_ts, last_ts, n`` of complete micro-batches; None before the first."""
    names = [n for n in child_names(spark, f"{root}/index") if n.startswith("batch_id=")]
    paths = [f"{root}/index/{n}" for n in names if path_exists(spark, f"{root}/index/{n}/_SUCCESS")]
    return spark.read.option("basePath", f"{root}/index").parquet(*paths) if paths else None


def _within(first: Column, last: Column, start, end) -> Column:
    """Whether ``[first, last]`` meets ``[start, end)``; a bound that is None is open."""
    meets = F.lit(True)
    if start is not None:
        meets &= last >= F.lit(start)
    if end is not None:
        meets &= first < F.lit(end)
    return meets


def files_of(
    spark: SparkSession, root: str, offsets: tuple = (None, None), times: tuple = (None, None)
) -> list[str]:
    """Files that hold records of the range: as many as the replay has to read."""
    index = read_index(spark, root)
    if index is None:
        return []
    wanted = index.filter(_within(F.col("first_offset"), F.col("last_offset"), *offsets) & _within(F.col("first_ts"), F.col("last_ts"), *times))
    return [f"{root}/data/batch_id={r.batch_id}/{r.file}" for r in wanted.select("batch_id", "file").collect()]


def replay_indexed(
    spark: SparkSession, root: str, schema, offset: str, ts: str, offsets: tuple = (None, None), times: tuple = (None, None)
) -> DataFrame:
    """The records from ``start`` up to but without ``end``, by offset, time or both; a bound that is None is open."""
    files = files_of(spark, root, offsets, times)
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    for column, (start, end) in ((offset, offsets), (ts, times)):
        if start is not None:
            rows = rows.filter(F.col(column) >= F.lit(start))
        if end is not None:
            rows = rows.filter(F.col(column) < F.lit(end))
    return rows
