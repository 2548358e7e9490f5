"""The streaming queries, built from the same operators as the batch jobs.

Two chained queries. The first takes raw texts to outcomes (processed orders and dead letters) and
has no watermark, so late orders still reach the processed output. The second reads processed orders
and computes windows under a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions.running import running
from orderflow.functions.scalar import iso_text, time_bin
from orderflow.operators.enrich import enrich_orders, from_wire_json, to_wire_json
from orderflow.operators.validate import route, to_dlq, validate_orders
from orderflow.operators.windows import finish_windows, window_accumulate, with_event_time
from orderflow.session import delete_path, path_exists, stage, staging_scope
from orderflow.streaming.dedup import accept_batch, mark_duplicates
from orderflow.streaming.memory import AcceptedKeys
from orderflow.streaming.sinks import batch_path

OUTCOME = (
    "order_id string, arrival_seq {seq}, arrival_ts timestamp, error_type string,"
    " error_message string, value string, batch_id bigint, outcome string"
)


def with_outcome_text(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Validate and enrich; ``value`` becomes the enriched JSON of a valid order and stays the raw
    text of any other. One parse per record."""
    checked = enrich_orders(validate_orders(df), at)
    wire = to_wire_json(checked, "enriched", into="_wire")
    return wire.withColumn(
        "value", F.when(F.col("error_type").isNull(), F.col("_wire")).otherwise(F.col("value"))
    ).select("order_id", "arrival_seq", "arrival_ts", "error_type", "error_message", "value")


def write_outcomes(
    root: str, ttl_seconds: int = C.DEDUP_TTL_SECONDS, at: Column | None = None
) -> Callable[[DataFrame, int], None]:
    """Raw records of each micro-batch to ``root/outcomes``, one row per record with ``outcome``
    (``processed`` or ``dlq``); the memory of accepted orders is ``root/accepted``.

    Everything runs in the JVM. Rejected rows do not take part in the de-duplication. The outcome of a
    micro-batch is written once: where its folder is complete, a repeated run leaves it as it is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = batch_path(f"{root}/outcomes", batch_id)
        if path_exists(spark, f"{target}/_SUCCESS"):
            return
        with staging_scope(spark):
            checked = stage(with_outcome_text(batch, at), "checked-batch")
            memory = AcceptedKeys(spark, f"{root}/accepted", ttl_seconds)
            accepted = accept_batch(route(checked)[0], batch_id, memory)
            repeated = F.concat(
                F.lit("Order "), F.col("order_id"), F.lit(" already processed within deduplication window")
            )
            duplicate = F.col("is_dup") & F.col("error_type").isNull()
            judged = mark_duplicates(checked, accepted).select(
                "order_id", "arrival_seq", "arrival_ts",
                F.when(duplicate, "DUPLICATE").otherwise(F.col("error_type")).alias("error_type"),
                F.when(duplicate, repeated).otherwise(F.col("error_message")).alias("error_message"),
                "value",
            )
            (
                judged.withColumn("outcome", F.when(F.col("error_type").isNull(), "processed").otherwise("dlq"))
                .write.mode("overwrite").partitionBy("outcome").parquet(target)
            )

    return write


def read_outcomes(spark: SparkSession, root: str, seq: str = "bigint", streaming: bool = False) -> DataFrame:
    """What :func:`write_outcomes` has written, as a table or as the stream that the second query reads."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(OUTCOME.format(seq=seq)).option("basePath", f"{root}/outcomes").parquet(f"{root}/outcomes")


def processed_of(outcomes: DataFrame) -> DataFrame:
    """Typed processed orders with their arrival and event time."""
    ok = outcomes.filter(F.col("outcome") == "processed")
    return with_event_time(from_wire_json(ok, "enriched", keep=("arrival_seq", "arrival_ts")))


def dlq_of(outcomes: DataFrame, at: Column | None = None) -> DataFrame:
    stamp = iso_text(F.current_timestamp() if at is None else at)
    return to_dlq(outcomes.filter(F.col("outcome") == "dlq"), stamp)


def region_windows(
    processed: DataFrame, size: str = C.ORDER_WINDOW, lateness: str = C.LATENESS
) -> DataFrame:
    """Window metrics under the watermark; with append output a window is emitted once, closed.

    With update output and a longer ``lateness`` it re-emits a window on every allowed late row.
    """
    return finish_windows(
        window_accumulate(processed.withWatermark("event_time", lateness), ["region"], size)
    )


def route_late_batches(
    root: str, size_seconds: int = C.ORDER_WINDOW_SECONDS, lateness_seconds: int = C.LATENESS_SECONDS
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: late rows to their own table, by the largest event time seen before each.

    What earlier batches saw is one value: each batch adds its own to its predecessor's and leaves one row
    under ``root/seen``. A watermark upstream would have dropped the late rows before they could be
    routed. ``root/counts`` has the rows and late rows of each batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with staging_scope(spark):
            before = batch_path(f"{root}/seen", batch_id - 1)
            earlier = spark.read.parquet(before).first()[0] if path_exists(spark, before) else None
            rows = running(
                batch.withColumn("_event_us", F.unix_micros("event_time")),
                [], "arrival_ts", None, {"_in_batch": ("max", "_event_us")}, ties=("arrival_seq",),
            )
            closes = (
                F.unix_seconds(time_bin(F.col("event_time"), size_seconds))
                + size_seconds + lateness_seconds
            ) * 1_000_000
            seen = F.greatest(F.col("_in_batch"), F.lit(earlier).cast("bigint"))
            flagged = stage(
                rows.withColumn("_late", F.coalesce(closes <= seen, F.lit(False))).drop("_in_batch"), "late-batch"
            )
            for name, late in (("on_time", False), ("late", True)):
                flagged.filter(F.col("_late") == late).drop("_late", "_event_us").write.mode(
                    "overwrite"
                ).parquet(batch_path(f"{root}/{name}", batch_id))
            flagged.agg(F.count("*").alias("rows_in"), F.count_if("_late").alias("rows_late")).write.mode(
                "overwrite"
            ).parquet(batch_path(f"{root}/counts", batch_id))
            own = flagged.agg(F.greatest(F.max("_event_us"), F.lit(earlier).cast("bigint")).alias("seen_us"))
            own.coalesce(1).write.mode("overwrite").parquet(batch_path(f"{root}/seen", batch_id))
            delete_path(spark, batch_path(f"{root}/seen", batch_id - 2))

    return write
