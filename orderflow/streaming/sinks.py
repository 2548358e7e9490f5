"""Streaming sinks. Each can be retried: a repeated micro-batch leaves the same table behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from orderflow.operators.features import newest_rank, online_latest
from orderflow.operators.rollups import coarser, rollup
from orderflow.session import child_names, delete_path, path_exists, stage, staging_scope
from orderflow.sources.lake import FLUSH_INTERVAL, write_lake

CHECKPOINT_INTERVAL = "60 seconds"


def _trigger(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    """A processing-time trigger, or one pass over what is there when ``interval`` is None."""
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def write_table(
    df: DataFrame, path: str, checkpoint: str, interval: str | None = CHECKPOINT_INTERVAL,
    partition_by: list[str] | None = None, mode: str = "append",
) -> StreamingQuery:
    """Parquet file sink; its own log makes each micro-batch visible once."""
    writer = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode(mode)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, interval).start()


def write_kafka(
    df: DataFrame, servers: str, topic: str, checkpoint: str,
    interval: str | None = CHECKPOINT_INTERVAL, options: dict[str, str] | None = None,
) -> StreamingQuery:
    """JSON texts (column ``value``) to a topic. Needs the Kafka connector on the cluster."""
    writer = (
        df.select("value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .options(**(options or {}))
        .outputMode("append")
    )
    return _trigger(writer, interval).start()


def write_each(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
    interval: str | None = CHECKPOINT_INTERVAL, mode: str = "append",
) -> StreamingQuery:
    writer = (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    )
    return _trigger(writer, interval).start()


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def archive_messages(path: str) -> Callable[[DataFrame, int], None]:
    """Enveloped messages of each micro-batch as JSON lines; an empty batch writes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch.select(
            F.col("value").alias("message"), "topic", "partition", "offset", "timestamp"
        ).write.mode("overwrite").json(batch_path(path, batch_id))

    return write


def write_lake_batches(path: str, ts: str, rows_per_file: int = 2_000_000) -> Callable[[DataFrame, int], None]:
    """Each flush as hour-partitioned gzip Parquet in a folder of its own, which a repeated flush overwrites.

    A flush counts its rows per hour first, so an hour is written by as many tasks as it needs files, however
    few hours the flush has. Compaction merges the folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with staging_scope(batch.sparkSession):
            rows = stage(batch, "flush")
            if not rows.isEmpty():
                write_lake(rows, batch_path(path, batch_id), ts, "overwrite", rows_per_file)

    return write


def write_lake_stream(
    df: DataFrame, path: str, checkpoint: str, ts: str, interval: str | None = FLUSH_INTERVAL,
    rows_per_file: int = 2_000_000,
) -> StreamingQuery:
    """The lake sink, flushed at the interval."""
    return write_each(df, write_lake_batches(path, ts, rows_per_file), checkpoint, interval)


#: Micro-batches after which an upsert log begins anew with one row per key.
GENERATION = 16


def upsert_by_key(
    path: str, keys: list[str] | None = None, order: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Idempotent upsert log: each micro-batch owns one ``batch_id=`` folder and overwrites it, so a repeated batch
    changes nothing. :func:`read_upserted` resolves the newest row per key.

    With ``keys`` the log is compacted: every :data:`GENERATION` micro-batches a new generation begins with the
    newest row per key, and the one before the last is deleted. Without, it keeps all history.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, generation = batch.sparkSession, batch_id // GENERATION if keys else 0
        carried = f"{path}/generation={generation}/batch_id=-1"
        if generation and batch_id % GENERATION == 0:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
            _newest(_log(spark, path, generation - 1, schema), keys, order).write.mode("overwrite").parquet(carried)
            delete_path(spark, f"{path}/generation={generation - 2}")
        batch.write.mode("overwrite").parquet(batch_path(f"{path}/generation={generation}", batch_id))

    return write


def _log(spark: SparkSession, path: str, generation: int, schema: str) -> DataFrame:
    folder = f"{path}/generation={generation}"
    return spark.read.schema(f"{schema}, batch_id bigint").option("basePath", folder).parquet(folder)


def _newest(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Newest row per key: by ``order`` when given, later batches and then larger rows breaking ties. One grouped
    ``max_by``, reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    rank = F.struct(*([newest_rank(rows, order)] if order else []), "batch_id", *rest)
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def read_upserted(
    spark: SparkSession, path: str, keys: list[str], schema: str, order: str | None = None
) -> DataFrame:
    """The current table: the newest row per key of the newest complete generation."""
    found = [int(name.partition("=")[2]) for name in child_names(spark, path) if name.startswith("generation=")]
    complete = [g for g in found if g == 0 or path_exists(spark, f"{path}/generation={g}/batch_id=-1/_SUCCESS")]
    generation = max(complete, default=0)
    return _newest(_log(spark, path, generation, schema), keys, order)


def fan_out(outputs: dict[str, Callable[[DataFrame], DataFrame]], root: str) -> Callable[[DataFrame, int], None]:
    """Several outputs off one parsed micro-batch: it is computed once and kept while they write."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, select in outputs.items():
                select(batch).write.mode("overwrite").parquet(
                    batch_path(f"{root}/{name}", batch_id)
                )
        finally:
            batch.unpersist()

    return write


def ingest_features(
    root: str, key: str, event_time: str, tie: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Offline history (append, by event date) and the online upsert log in one pass. The newest record is found by the
    event time as a time and, among equal times, by ``tie`` or else by the whole record."""
    online = upsert_by_key(f"{root}/online", [key], event_time)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            offline_append(batch, f"{root}/offline", event_time, batch_id)
            online(online_latest(batch, key, event_time, tie), batch_id)
        finally:
            batch.unpersist()

    return write


def offline_append(df: DataFrame, path: str, event_time: str, batch_id: int) -> None:
    """Immutable history: one folder per batch, partitioned by event date inside it."""
    (
        df.withColumn("event_date", F.to_date(F.col(event_time).cast("timestamp")))
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(batch_path(path, batch_id))
    )


def rollup_batches(path: str, keys: list[str], ts: str, value: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch's minute rollups with their sketches, by day, in a folder that a repeated micro-batch overwrites. Raw points are
    not needed again: minutes that several micro-batches touch are merged by :func:`read_rollups`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = rollup(batch, keys, ts, value).withColumn("day", F.to_date("start"))
        rows.write.mode("overwrite").partitionBy("day").parquet(batch_path(path, batch_id))

    return write


def read_rollups(spark: SparkSession, path: str, keys: list[str], unit: str | None = "minute", since: str | None = None) -> DataFrame:
    """Rollups of all micro-batches, merged to ``unit``; ``since`` is a day, and older days are not read."""
    rows = spark.read.parquet(path)
    return coarser(rows.filter(F.col("day") >= since) if since else rows, keys, unit)
