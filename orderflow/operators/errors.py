"""Error analytics over dead letters and log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions.scalar import time_bin


def errors_by_type(df: DataFrame, types: list[str], column: str = "error_type") -> DataFrame:
    return (
        df.filter(F.col(column).isin(*types))
        .groupBy(column)
        .agg(F.count("*").alias("error_count"))
        .orderBy(F.desc("error_count"), column)
    )


def error_share(df: DataFrame, column: str = "error_type", dominant: float = 80.0) -> DataFrame:
    """Count and percent of all errors per type. The total is a scalar subquery over the counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("error_count")
    )
    total = counts.agg(F.sum("error_count")).scalar()
    return counts.withColumn(
        "percent", F.round(F.col("error_count") * 100.0 / total, 2)
    ).withColumn("is_dominant", F.col("percent") > dominant)


def dlq_rate_per_minute(
    df: DataFrame, ts: str = "error_timestamp", warn: int = 10, alarm: int = 100
) -> DataFrame:
    return (
        df.groupBy(F.date_trunc("minute", ts).alias("minute"))
        .agg(F.count("*").alias("dlq_count"))
        .withColumn(
            "level",
            F.when(F.col("dlq_count") > alarm, "red")
            .when(F.col("dlq_count") >= warn, "yellow")
            .otherwise("normal"),
        )
    )


def dlq_by_type_per_minute(
    df: DataFrame, ts: str = "error_timestamp", column: str = "error_name",
    types: list[str] | None = None,
) -> DataFrame:
    """One column per error type. The values are given, so no extra pass looks them up."""
    types = types or C.LOG_ERROR_TYPES
    return df.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(
        *[F.count_if(F.col(column) == t).alias(t) for t in types]
    )


def top_error_orders(df: DataFrame, n: int = 20, order_id: str = "order_id") -> DataFrame:
    return (
        df.filter(F.col("error_type").isNotNull() & (F.col("error_type") != ""))
        .groupBy(order_id)
        .agg(F.count("*").alias("error_count"))
        .orderBy(F.desc("error_count"), order_id)
        .limit(n)
    )


def timeout_trend(df: DataFrame, ts: str = "timestamp", seconds: int = 300) -> DataFrame:
    return (
        df.filter(F.col("error_type") == "timeout")
        .groupBy(time_bin(F.col(ts), seconds).alias("bin_start"))
        .agg(F.count("*").alias("timeout_count"))
    )


def errors_by_operator(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("level") == "ERROR")
        .groupBy("operator")
        .agg(F.count("*").alias("error_count"))
        .orderBy(F.desc("error_count"), "operator")
    )


def dlq_spike_cause(
    df: DataFrame, types: list[str], ts: str = "timestamp", seconds: int = 300, above: int = 100
) -> DataFrame:
    return (
        df.filter(F.col("error_type").isin(*types))
        .groupBy(time_bin(F.col(ts), seconds).alias("bin_start"), "error_type")
        .agg(F.count("*").alias("error_count"))
        .filter(F.col("error_count") > above)
    )


def recent_errors(
    df: DataFrame, now: Column, types: list[str], seconds: int = 3600, ts: str = "timestamp"
) -> DataFrame:
    since = F.timestamp_seconds(F.unix_seconds(now) - seconds)
    return errors_by_type(df.filter((F.col(ts) > since) & (F.col(ts) <= now)), types)


def trace_order(df: DataFrame, order_id: Column, ts: str = "timestamp") -> DataFrame:
    """One order's log events in time order."""
    return (
        df.filter(F.col("order_id") == order_id)
        .select(ts, "order_id", "operator", "latency_ms", "status", "message")
        .orderBy(ts)
    )
