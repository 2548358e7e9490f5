"""Event-time windows: tumbling, sliding, sessions, co-grouped streams, emit latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions import scalar as S
from orderflow.functions.percentiles import exact_percentiles


def with_event_time(df: DataFrame, text: str = "timestamp") -> DataFrame:
    return df.withColumn("event_time", S.iso_timestamp(F.col(text)))


def with_bounded_lateness(
    df: DataFrame, ts: str = "event_time", delay: str = C.LATENESS
) -> DataFrame:
    """Watermark = largest event time seen − ``delay`` (takes effect in streaming queries)."""
    return df.withWatermark(ts, delay)


def tumbling(df: DataFrame, size: str = C.ORDER_WINDOW, ts: str = "event_time") -> DataFrame:
    """Add the epoch-aligned ``window_start`` and ``window_end`` of each row."""
    w = F.window(ts, size)
    return df.withColumn("_w", w).select(
        *df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")
    )


def window_accumulate(
    df: DataFrame, keys: list[str], size: str = C.ORDER_WINDOW, ts: str = "event_time",
    slide: str | None = None,
) -> DataFrame:
    """Mergeable partials per (key, window): count, sum, maximum.

    Five regions do not mean five busy tasks: each input partition reduces to one row per
    (key, window) before the shuffle.
    """
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        df.groupBy(w.alias("_w"), *keys)
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("amount").cast("decimal(38,6)").alias("total_amount"),
            F.max("amount").alias("max_order_value"),
        )
        .select(
            *keys,
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "total_orders",
            "total_amount",
            "max_order_value",
        )
    )


def merge_accumulators(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge partials of the same (key, window), for example of several batches."""
    return parts.groupBy(*keys, "window_start", "window_end").agg(
        F.sum("total_orders").alias("total_orders"),
        F.sum("total_amount").cast("decimal(38,6)").alias("total_amount"),
        F.max("max_order_value").alias("max_order_value"),
    )


def finish_windows(parts: DataFrame, emitted_at: Column | None = None) -> DataFrame:
    """Average and emit time of accumulated windows."""
    at = F.current_timestamp() if emitted_at is None else emitted_at
    return parts.withColumn(
        "avg_order_value", S.half_even_average(F.col("total_amount"), F.col("total_orders"))
    ).withColumn("processing_timestamp_ms", F.unix_millis(at))


def region_window_metrics(
    df: DataFrame, size: str = C.ORDER_WINDOW, emitted_at: Column | None = None
) -> DataFrame:
    return finish_windows(window_accumulate(df, ["region"], size), emitted_at)


def sliding(df: DataFrame, keys: list[str], size: str, slide: str) -> DataFrame:
    return finish_windows(window_accumulate(df, keys, size, slide=slide), F.col("window_end"))


def sessions(
    df: DataFrame, key: str, gap_seconds: int, ts: str = "event_time", amount: str = "amount"
) -> DataFrame:
    """Gap-merged windows per key; a session ends one gap after its last row, touching ones merge.

    Rows of one gap-long slice always belong together, so each (key, slice) is first reduced to one
    fragment by a grouped aggregate; only fragments (at most one per gap of time) are then merged
    in key order. A key with a third of all rows is reduced before the shuffle like any other.
    """
    gap = gap_seconds * 1_000_000
    at = F.unix_micros(ts)
    fragments = df.groupBy(F.col(key), S.floor_div(at, gap).alias("_slice")).agg(
        F.min(at).alias("_first"),
        F.max(at).alias("_last"),
        F.count("*").alias("_n"),
        F.sum(amount).alias("_sum"),
        F.max(amount).alias("_max"),
    )
    in_order = Window.partitionBy(key).orderBy("_slice")
    opens = F.when(F.col("_first") - F.lag("_last").over(in_order) <= gap, 0).otherwise(1)
    numbered = fragments.withColumn("_opens", opens).withColumn(
        "_session", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy(key, "_session")
        .agg(
            F.timestamp_micros(F.min("_first")).alias("session_start"),
            F.timestamp_micros(F.max("_last") + gap).alias("session_end"),
            F.sum("_n").alias("total_orders"),
            F.sum("_sum").cast("decimal(38,6)").alias("total_amount"),
            F.max("_max").alias("max_order_value"),
        )
        .drop("_session")
    )


def sessions_stream(df: DataFrame, key: str, gap: str, ts: str = "event_time") -> DataFrame:
    """The same sessions as a streaming aggregation (needs a watermark upstream)."""
    return (
        df.groupBy(key, F.session_window(ts, gap).alias("_w"))
        .agg(F.count("*").alias("total_orders"), F.sum("amount").alias("total_amount"))
        .select(
            key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"),
            "total_orders", "total_amount",
        )
    )


def tick_window_stats(df: DataFrame, size: str = C.TICK_WINDOW, ts: str = "datetime") -> DataFrame:
    """Per ticker and window: count, average, minimum and maximum price, total volume."""
    return (
        df.groupBy(F.window(ts, size).alias("_w"), "ticker")
        .agg(
            F.count("*").alias("count"),
            F.round(F.avg("price"), 6).alias("avg_price"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            F.sum("volume").alias("total_volume"),
        )
        .select(
            "ticker",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "count", "avg_price", "min_price", "max_price", "total_volume",
        )
    )


def window_cogroup(
    left: DataFrame, right: DataFrame, key: str, size: str, left_agg: dict, right_agg: dict,
    left_ts: str = "event_time", right_ts: str = "event_time",
) -> DataFrame:
    """Two keyed streams met per window, each reduced first, so no pairs of rows are formed."""

    def reduce(df: DataFrame, ts: str, aggs: dict) -> DataFrame:
        return (
            df.groupBy(F.window(ts, size).alias("_w"), key)
            .agg(*[column.alias(name) for name, column in aggs.items()])
            .select(key, F.col("_w.start").alias("window_start"), *aggs)
        )

    return reduce(left, left_ts, left_agg).join(
        reduce(right, right_ts, right_agg), [key, "window_start"], "full"
    )


def window_cogroup_stream(
    left: DataFrame, right: DataFrame, key: str, size: str, left_agg: dict, right_agg: dict,
    left_ts: str = "event_time", right_ts: str = "event_time", lateness: str = C.LATENESS,
) -> DataFrame:
    """The same of two streams: each is reduced per window under its watermark, and closed windows meet in a full outer
    join, so its state holds one row per key and open window."""

    def reduce(df: DataFrame, ts: str, aggs: dict, names: tuple[str, str]) -> DataFrame:
        return (
            df.withWatermark(ts, lateness)
            .groupBy(F.window(ts, size).alias(names[0]), F.col(key).alias(names[1]))
            .agg(*[column.alias(name) for name, column in aggs.items()])
        )

    a = reduce(left, left_ts, left_agg, ("_wa", "_ka"))
    b = reduce(right, right_ts, right_agg, ("_wb", "_kb"))
    joined = a.join(b, (F.col("_wa") == F.col("_wb")) & (F.col("_ka") == F.col("_kb")), "full_outer")
    return joined.select(
        F.coalesce("_ka", "_kb").alias(key), F.coalesce("_wa.start", "_wb.start").alias("window_start"), *left_agg, *right_agg
    )


def window_emit_latency(
    agg: DataFrame, probabilities: dict[str, float], slo_ms: int = 2000
) -> DataFrame:
    """Percentiles of emit time − window end, and whether p99 breaks the objective."""
    delay = agg.withColumn(
        "emit_latency_ms", F.col("processing_timestamp_ms") - F.unix_millis("window_end")
    )
    result = exact_percentiles(delay, [], "emit_latency_ms", probabilities)
    last = list(probabilities)[-1]
    return result.withColumn("breach", F.col(last) > slo_ms)
