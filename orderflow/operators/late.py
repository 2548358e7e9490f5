"""Late data in batch: the per-arrival watermark, late routing, corrections, watermark lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions import scalar as S
from orderflow.functions.running import running
from orderflow.operators.windows import finish_windows, window_accumulate
from orderflow.session import stage


def with_seen_before(
    df: DataFrame, arrival_ts: str = "arrival_ts", arrival_seq: str = "arrival_seq"
) -> DataFrame:
    """Add ``seen_before``, the largest event time among strictly earlier arrivals.

    Arrivals are ordered by (arrival_ts, arrival_seq) and dealt by range of that order, so a busy
    minute is as many tasks as its rows need. The input is computed once.
    """
    micros = df.withColumn("_event_us", F.unix_micros("event_time"))
    out = running(micros, [], arrival_ts, None, {"_seen": ("max", "_event_us")}, ties=(arrival_seq,))
    return out.withColumn("seen_before", F.timestamp_micros("_seen")).drop("_event_us", "_seen")


def flag_late(
    df: DataFrame,
    size_seconds: int = C.ORDER_WINDOW_SECONDS,
    lateness_seconds: int = C.LATENESS_SECONDS,
    **order: str,
) -> DataFrame:
    """Add ``window_end`` and ``is_late``: the row's window closed before the row arrived.

    A window is closed once its end plus the lateness is at or before the largest event time seen.
    """
    seen = with_seen_before(df, **order)
    end = F.timestamp_seconds(
        F.unix_seconds(S.time_bin(F.col("event_time"), size_seconds)) + size_seconds
    )
    closes = F.unix_micros("window_end") + lateness_seconds * 1_000_000
    return (
        seen.withColumn("window_end", end)
        .withColumn("is_late", F.coalesce(closes <= F.unix_micros("seen_before"), F.lit(False)))
    )


def route_late(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows), as two views of one stored result."""
    flagged = stage(flag_late(df, **options), "late-flags")
    return flagged.filter(~F.col("is_late")), flagged.filter("is_late")


def drop_late(df: DataFrame, **options) -> DataFrame:
    return flag_late(df, **options).filter(~F.col("is_late"))


def late_count(df: DataFrame, **options) -> DataFrame:
    flagged = flag_late(df, **options)
    return flagged.agg(
        F.count("*").alias("rows_in"), F.count_if("is_late").alias("rows_late")
    )


def windows_with_corrections(
    df: DataFrame,
    size: str = C.ORDER_WINDOW,
    size_seconds: int = C.ORDER_WINDOW_SECONDS,
    out_of_order_seconds: int = C.LATENESS_SECONDS,
    allowed_seconds: int = 1800,
) -> DataFrame:
    """Each window's first result and its corrections, in ``version`` order.

    Rows that come after their window closed but within the allowed lateness re-emit the window;
    later ones are dropped. Corrections that arrive in the same minute are emitted as one version,
    as a micro-batch would. The versions of one window are few: minutes of allowed lateness.
    """
    flagged = flag_late(df, size_seconds, out_of_order_seconds)
    too_late = (
        F.unix_seconds("window_end") + out_of_order_seconds + allowed_seconds
    ) * 1_000_000 <= F.unix_micros("seen_before")
    kept = flagged.filter(~F.coalesce(too_late, F.lit(False)))
    stage = F.when(F.col("is_late"), F.date_trunc("minute", "arrival_ts"))
    parts = window_accumulate(
        kept.drop("window_end").withColumn("_stage", stage), ["region", "_stage"], size
    )
    so_far = (
        Window.partitionBy("region", "window_start")
        .orderBy(F.col("_stage").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    versions = parts.select(
        "region",
        "window_start",
        "window_end",
        F.row_number().over(
            Window.partitionBy("region", "window_start").orderBy(F.col("_stage").asc_nulls_first())
        ).alias("version"),
        F.sum("total_orders").over(so_far).alias("total_orders"),
        F.sum("total_amount").over(so_far).cast("decimal(38,6)").alias("total_amount"),
        F.max("max_order_value").over(so_far).alias("max_order_value"),
        F.col("_stage").isNotNull().alias("is_correction"),
    )
    return finish_windows(versions, F.col("window_end"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """What an upserting sink holds in the end: the last version per (region, window)."""
    rest = [c for c in versions.columns if c not in ("region", "window_start")]
    return (
        versions.groupBy("region", "window_start")
        .agg(F.max_by(F.struct(*rest), "version").alias("_r"))
        .select("region", "window_start", *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def watermark_lag(
    df: DataFrame, lateness_seconds: int = C.LATENESS_SECONDS, alarm_seconds: int = 60,
    stuck_seconds: int = 300,
) -> DataFrame:
    """Per arrival minute: clock − (watermark + lateness); that is how far event time trails."""
    per_minute = (
        df.groupBy(F.date_trunc("minute", "arrival_ts").alias("minute"))
        .agg(F.max(F.unix_micros("event_time")).alias("_max_us"))
        .withColumn("_minute_no", F.unix_seconds("minute").cast("bigint"))
    )
    seen = running(
        per_minute, [], "_minute_no", 3600, {"_seen": ("max", "_max_us")}, include_current=True
    )
    lag = (F.col("_minute_no") + 60) * 1000 - S.floor_div(F.col("_seen"), 1000)
    return seen.select(
        "minute",
        F.timestamp_micros(F.col("_seen") - lateness_seconds * 1_000_000).alias("watermark"),
        lag.alias("watermark_lag_ms"),
    ).withColumn(
        "state",
        F.when(F.col("watermark_lag_ms") > stuck_seconds * 1000, "stuck")
        .when(F.col("watermark_lag_ms") > alarm_seconds * 1000, "lagging")
        .otherwise("ok"),
    )
