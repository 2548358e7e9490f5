"""Readers for order, tick, log and captured-batch records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions.scalar import iso_timestamp
from orderflow.schemas import LOG_EVENT


def _kafka_options(servers: str, topic: str, options: dict[str, str] | None) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        **(options or {}),
    }


def read_orders_stream(spark: SparkSession, source: dict) -> DataFrame:
    """Order texts as a stream from the earliest record.

    ``{"kafka": servers, "topic": …, "options": {…}}`` or, for replays and tests,
    ``{"files": folder, "format": …, "schema": …, "options": {…}}``.
    """
    if "kafka" in source:
        options = _kafka_options(
            source["kafka"], source.get("topic", C.RAW_TOPIC), source.get("options")
        )
        return read_envelopes(spark.readStream.format("kafka").options(**options).load())
    return (
        spark.readStream.format(source.get("format", "parquet"))
        .schema(source["schema"])
        .options(**source.get("options", {}))
        .load(source["files"])
    )


def read_orders_batch(spark: SparkSession, source: dict) -> DataFrame:
    """The same records as a bounded table; Kafka takes ``startingOffsets``/``endingOffsets``."""
    if "kafka" in source:
        options = _kafka_options(
            source["kafka"], source.get("topic", C.RAW_TOPIC), source.get("options")
        )
        return read_envelopes(spark.read.format("kafka").options(**options).load())
    reader = spark.read.format(source.get("format", "parquet")).options(**source.get("options", {}))
    if "schema" in source:
        reader = reader.schema(source["schema"])
    return reader.load(source["files"])


def read_envelopes(df: DataFrame) -> DataFrame:
    """Decoded value beside its topic, partition, offset and broker time.

    Arrivals are ordered by (arrival_ts, arrival_seq): by broker time, which has milliseconds and is shared by
    many records, then by partition and offset. The pair (partition, offset) also names a record for good.
    """
    arrival = F.col("timestamp").cast("timestamp")
    return df.select(
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        arrival.alias("arrival_ts"),
        F.struct("partition", "offset").alias("arrival_seq"),
    )


def decode_envelopes(df: DataFrame) -> DataFrame:
    """Envelopes whose value is base64 text (the broker's event-batch form)."""
    return df.withColumn("value", decode_base64(F.col("value")))


def decode_base64(value: Column) -> Column:
    """UTF-8 text of a base64 value; NULL when it is neither."""
    return F.try_validate_utf8(F.try_to_binary(value, F.lit("base64")).cast("string"))


def explode_captured_batch(df: DataFrame, value: str = "value") -> DataFrame:
    """Records of captured batches: ``{"records": {"topic-0": [{value: base64}]}}``, a bare list, or
    one bare object. Adds ``topic_partition`` and the record's JSON text as ``payload``; records
    that cannot be decoded or parsed are left out."""
    doc = F.try_parse_json(F.col(value))
    kept = [c for c in df.columns if c != value]
    base = df.withColumn("_doc", doc)
    grouped = F.try_variant_get("_doc", "$.records", "map<string,array<variant>>")
    bare_list = F.try_variant_get("_doc", "$", "array<variant>")
    nothing = F.lit(None).cast("string").alias("topic_partition")
    record = "struct<topic_partition:string,payload:string>"
    encoded = F.flatten(
        F.transform(
            F.map_entries(grouped),
            lambda part: F.transform(
                part["value"],
                lambda r: F.struct(
                    part["key"].alias("topic_partition"),
                    decode_base64(F.try_variant_get(r, "$.value", "string")).alias("payload"),
                ),
            ),
        )
    )
    listed = F.transform(bare_list, lambda r: F.struct(nothing, F.to_json(r).alias("payload")))
    single = F.when(
        F.try_variant_get("_doc", "$.records", "variant").isNull(), F.array(F.struct(nothing, F.col(value).alias("payload")))
    )
    # One parse and one pass: a document has one of the three shapes.
    shapes = F.coalesce(encoded.cast(f"array<{record}>"), listed.cast(f"array<{record}>"), single.cast(f"array<{record}>"))
    return base.select(*kept, F.inline(shapes)).filter(F.json_object_keys("payload").isNotNull())


def parse_ticks(df: DataFrame, value: str = "value") -> DataFrame:
    """``{datetime, ticker, price[, volume]}`` texts to typed ticks. A tick may lack any of its fields; only texts that are no
    JSON object are left out, see :func:`malformed_ticks`."""
    rest = [c for c in df.columns if c != value]
    tick = F.from_json(
        F.col(value), "datetime string, ticker string, price double, volume bigint"
    )
    parsed = df.withColumn("_t", tick)
    return parsed.filter(_is_object(F.col(value))).select(
        *rest,
        iso_timestamp(F.col("_t.datetime")).alias("datetime"),
        F.col("_t.ticker").alias("ticker"),
        F.col("_t.price").alias("price"),
        F.col("_t.volume").alias("volume"),
    )


def _is_object(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text).isNotNull(), F.lit(False))


def malformed_ticks(df: DataFrame, value: str = "value") -> DataFrame:
    """The texts that :func:`parse_ticks` cannot read, as they came."""
    return df.filter(~_is_object(F.col(value)))


def read_ticks(spark: SparkSession, source: dict, streaming: bool = False) -> DataFrame:
    read = read_orders_stream if streaming else read_orders_batch
    return parse_ticks(read(spark, source))


def parse_log_events(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON log lines to typed columns with the nested ``context``."""
    return df.select(F.from_json(F.col(value), LOG_EVENT).alias("_e")).filter(
        F.col("_e").isNotNull()
    ).select("_e.*")


def read_log_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_EVENT).json(path)


def read_reference(spark: SparkSession, path: str, key: str, fmt: str = "parquet") -> DataFrame:
    """A keyed lookup table, one row per key: of a repeated key the whole row that is smallest, column by
    column. Whether a join broadcasts it is the optimizer's decision, by its measured size."""
    return one_per_key(spark.read.format(fmt).load(path), key)


def one_per_key(table: DataFrame, key: str) -> DataFrame:
    rest = [c for c in table.columns if c != key]
    if not rest:
        return table.distinct()
    row = table.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return row.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def replay_from(df: DataFrame, order: str, start, end=None) -> DataFrame:
    """The part of a replayable source from ``start`` on, up to but without ``end``."""
    part = df.filter(F.col(order) >= start)
    return part if end is None else part.filter(F.col(order) < end)
