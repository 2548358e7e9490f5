"""Windows as a stream of versions: each fires when it closes, is corrected while late rows are allowed, and then is forgotten.

The state is a table of open panes: one row of partial sums per key, window and stage (on time, or the minute in which late rows came). It holds the windows
between the newest event time and the end of the allowed lateness and no others, whatever the age of the stream. A micro-batch reduces its rows to
partials, merges them with the panes, emits what closed or changed, and writes the panes that are still open; a repeated micro-batch begins from the
panes of its predecessor and leaves the same behind. Lateness is judged row by row in the order of arrival, as in the batch operator, so the versions do not
depend on where micro-batches begin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions.running import running
from orderflow.functions.scalar import join_on, time_bin
from orderflow.operators.windows import finish_windows, merge_accumulators, window_accumulate
from orderflow.session import delete_path, path_exists, stage, staging_scope
from orderflow.streaming.sinks import batch_path

PANE = "window_start timestamp, window_end timestamp, total_orders bigint, total_amount decimal(38,6), max_order_value decimal(24,6), _stage timestamp"


def _micros(seconds_after_end: int):
    return (F.unix_seconds("window_end") + seconds_after_end) * 1_000_000


def pane_batches(
    root: str,
    keys: list[str] = ["region"],  # noqa: B006
    size: str = C.ORDER_WINDOW,
    size_seconds: int = C.ORDER_WINDOW_SECONDS,
    out_of_order_seconds: int = C.LATENESS_SECONDS,
    allowed_seconds: int = 1800,
) -> Callable[[DataFrame, int], None]:
    """The sink of a stream of rows with ``keys, event_time, amount, arrival_ts, arrival_seq``: versions under ``root/versions``, rows that came after
    the allowed lateness under ``root/too_late``, the open panes under ``root/panes``."""
    gone = out_of_order_seconds + allowed_seconds

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with staging_scope(spark):
            earlier = batch_path(f"{root}/seen", batch_id - 1)
            seen_us = spark.read.parquet(earlier).first()[0] if path_exists(spark, earlier) else None
            micros = batch.withColumn("_event_us", F.unix_micros("event_time"))
            rows = running(micros, [], "arrival_ts", None, {"_seen": ("max", "_event_us")}, ties=("arrival_seq",))
            before = F.greatest(F.col("_seen"), F.lit(seen_us).cast("bigint"))
            end = F.timestamp_seconds(F.unix_seconds(time_bin(F.col("event_time"), size_seconds)) + size_seconds)
            flagged = rows.withColumn("window_end", end).withColumn("_before", before)
            late = F.coalesce(_micros(out_of_order_seconds) <= F.col("_before"), F.lit(False))
            flagged = stage(
                flagged.withColumn("_stage", F.when(late, F.date_trunc("minute", "arrival_ts")))
                .withColumn("_gone", F.coalesce(_micros(gone) <= F.col("_before"), F.lit(False)))
                .drop("_seen", "_before", "window_end"),
                "pane-rows",
            )
            flagged.filter("_gone").select(*batch.columns).write.mode("overwrite").parquet(batch_path(f"{root}/too_late", batch_id))
            newest = flagged.agg(F.max("_event_us")).first()[0]
            now_us = max((x for x in (seen_us, newest) if x is not None), default=None)

            fields = [*keys, "_stage"]
            parts = window_accumulate(flagged.filter("not _gone"), fields, size).withColumn("_touched", F.lit(True))
            parts = parts.withColumn("max_order_value", F.col("max_order_value").cast("decimal(24,6)"))
            held = _open_panes(spark, root, batch_id - 1, [f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys])
            both = parts if held is None else parts.unionByName(held.withColumn("_touched", F.lit(False)))
            touched = both.groupBy(*fields, "window_start").agg(F.max("_touched").alias("_touched"))
            merged = stage(join_on(merge_accumulators(both, fields), touched, [*fields, "window_start"]), "panes")

            closed_now = _micros(out_of_order_seconds) <= F.lit(now_us).cast("bigint")
            closed_before = F.coalesce(_micros(out_of_order_seconds) <= F.lit(seen_us).cast("bigint"), F.lit(False))
            emitted = _versions(merged, keys).filter(closed_now & (F.col("_touched") | ~closed_before)).drop("_touched")
            emitted.write.mode("overwrite").parquet(batch_path(f"{root}/versions", batch_id))
            still = merged.filter(F.coalesce(_micros(gone) > F.lit(now_us).cast("bigint"), F.lit(True))).drop("_touched")
            still.write.mode("overwrite").parquet(batch_path(f"{root}/panes", batch_id))
            seen = spark.range(1).select(F.lit(now_us).cast("bigint").alias("seen_us"))
            seen.coalesce(1).write.mode("overwrite").parquet(batch_path(f"{root}/seen", batch_id))
            for name in ("panes", "seen"):
                delete_path(spark, batch_path(f"{root}/{name}", batch_id - 2))

    return write


def _open_panes(spark: SparkSession, root: str, batch_id: int, keys: list[str]) -> DataFrame | None:
    path = batch_path(f"{root}/panes", batch_id)
    return spark.read.schema(", ".join([*keys, PANE])).parquet(path) if path_exists(spark, path) else None


def _versions(panes: DataFrame, keys: list[str]) -> DataFrame:
    """The result of a window at each of its stages. A window has few: minutes of allowed lateness."""
    order = Window.partitionBy(*keys, "window_start").orderBy(F.col("_stage").asc_nulls_first())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    versions = panes.select(
        *keys, "window_start", "window_end", "_touched",
        F.row_number().over(order).alias("version"),
        F.sum("total_orders").over(so_far).alias("total_orders"),
        F.sum("total_amount").over(so_far).cast("decimal(38,6)").alias("total_amount"),
        F.max("max_order_value").over(so_far).alias("max_order_value"),
        F.col("_stage").isNotNull().alias("is_correction"),
    )
    return finish_windows(versions, F.col("window_end"))


def read_versions(spark: SparkSession, root: str, keys: list[str] = ["region"]) -> DataFrame:  # noqa: B006
    """Every version of every window that has fired: a minute of corrections that two micro-batches share is one version, as the later left it."""
    rows = spark.read.option("basePath", f"{root}/versions").parquet(f"{root}/versions")
    rest = [c for c in rows.columns if c not in (*keys, "window_start", "version", "batch_id")]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("_r")
    return rows.groupBy(*keys, "window_start", "version").agg(newest).select(
        *keys, "window_start", "version", *[F.col(f"_r.{c}").alias(c) for c in rest]
    )
