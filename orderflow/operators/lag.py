"""Consumer lag from offset snapshots: size, trend, regressions and scaling advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PARTITION = ["topic", "partition"]


def consumer_lag(snapshots: DataFrame) -> DataFrame:
    """Per snapshot and topic: total and maximum lag, and the slowest partition."""
    lag = F.greatest(F.col("log_end_offset") - F.col("current_offset"), F.lit(0))
    return (
        snapshots.withColumn("lag", lag)
        .groupBy("ts", "topic")
        .agg(
            F.sum("lag").alias("total_lag"),
            F.max("lag").alias("max_lag"),
            F.max_by("partition", F.struct(F.col("lag"), -F.col("partition"))).alias("slowest_partition"),
        )
    )


def lag_trend(snapshots: DataFrame, flat_records: int = 1000) -> DataFrame:
    """Per partition: change of lag since the previous snapshot, as growing, stable or draining."""
    per = snapshots.withColumn("lag", F.col("log_end_offset") - F.col("current_offset"))
    order = Window.partitionBy(*_PARTITION).orderBy("ts")
    change = F.col("lag") - F.lag("lag").over(order)
    return per.withColumn("lag_change", change).select(
        *_PARTITION, "ts", "lag", "lag_change",
        F.when(F.col("lag_change") > flat_records, "growing")
        .when(F.col("lag_change") < -flat_records, "draining")
        .when(F.col("lag_change").isNotNull(), "stable")
        .otherwise("first")
        .alias("trend"),
    )


def lag_slope(snapshots: DataFrame) -> DataFrame:
    """Records of lag gained per hour over the whole span, per partition."""
    per = snapshots.withColumn("_lag", F.col("log_end_offset") - F.col("current_offset"))
    hours = (F.unix_seconds("ts") - F.lit(1704067200)) / 3600.0
    return per.groupBy(*_PARTITION).agg(
        F.count("*").alias("snapshots"),
        F.round(F.regr_slope("_lag", hours), 4).alias("lag_per_hour"),
    )


def offset_regression(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose committed offset is below the previous one: records are read again."""
    order = Window.partitionBy(*_PARTITION).orderBy("ts")
    previous = F.lag("current_offset").over(order)
    return (
        snapshots.withColumn("previous_offset", previous)
        .filter(F.col("current_offset") < F.col("previous_offset"))
        .select(
            *_PARTITION, "ts", "previous_offset", "current_offset",
            (F.col("previous_offset") - F.col("current_offset")).alias("replayed"),
        )
    )


def scale_advice(
    lag: DataFrame, parallelism: int = 4, low: int = 2, high: int = 32
) -> DataFrame:
    """Advice per snapshot from total lag and its direction.

    Below 10K hold; 10–50K one more; above 50K two more, three when still growing; above 100K page.
    """
    order = Window.partitionBy("topic").orderBy("ts")
    change = F.col("total_lag") - F.lag("total_lag").over(order)
    step = (
        F.when(F.col("total_lag") < 10000, 0)
        .when(F.col("total_lag") <= 50000, 1)
        .when(F.coalesce(F.col("_change") > 0, F.lit(False)), 3)
        .otherwise(2)
    )
    return (
        lag.withColumn("_change", change)
        .withColumn("step", step)
        .select(
            "ts", "topic", "total_lag",
            F.when(F.col("_change") > 0, "growing").when(F.col("_change") < 0, "falling")
            .otherwise("flat").alias("direction"),
            "step",
            F.greatest(F.least(F.lit(parallelism) + F.col("step"), F.lit(high)), F.lit(low))
            .alias("target_parallelism"),
            (F.col("total_lag") > 100000).alias("page"),
        )
    )
