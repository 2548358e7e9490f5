"""Alarm evaluation over a long metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.functions.percentiles import exact_percentiles

SPEC_SCHEMA = (
    "alarm_name string, metric_name string, statistic string, comparison string, threshold double,"
    " period_seconds int, evaluation_periods int, datapoints_to_alarm int,"
    " treat_missing_data string, severity string"
)

# The eleven alarms.
ALARM_SPECS = [
    ("dlq-spike-critical", "DLQRecordCount", "Sum", ">", 100.0, 60, 1, 1, "notBreaching", "CRITICAL"),
    ("checkpoint-failure-critical", "checkpoint_failures_total", "Sum", ">", 0.0, 300, 1, 1, "notBreaching", "CRITICAL"),
    ("kafka-broker-down-critical", "kafka_broker_alive_count", "Minimum", "<", 3.0, 60, 1, 1, "notBreaching", "CRITICAL"),
    ("firehose-delivery-failure-critical", "firehose_failed_put_count", "Sum", ">", 0.0, 60, 1, 1, "notBreaching", "CRITICAL"),
    ("kafka-consumer-lag-high", "consumer_lag_records", "Maximum", ">", 50000.0, 60, 2, 1, "notBreaching", "HIGH"),
    ("processing-latency-slo-breach", "LatencyP99", "Average", ">", 5000.0, 60, 2, 1, "notBreaching", "HIGH"),
    ("window-completeness-low", "WindowCompleteness", "Average", "<", 95.0, 300, 1, 1, "notBreaching", "HIGH"),
    ("memory-usage-high", "memory_usage_percentage", "Average", ">", 85.0, 60, 2, 1, "notBreaching", "MEDIUM"),
    ("checkpoint-duration-high", "checkpoint_duration_ms", "Average", ">", 30000.0, 60, 2, 1, "notBreaching", "MEDIUM"),
    ("duplicate-detection-spike", "DuplicateRecordDetected", "Sum", ">", 10.0, 60, 1, 1, "notBreaching", "MEDIUM"),
    ("deserialization-error-low", "kafka_deserialization_errors_total", "Sum", ">", 5.0, 60, 1, 1, "notBreaching", "LOW"),
]


def alarm_specs(spark: SparkSession, specs: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(ALARM_SPECS if specs is None else specs, SPEC_SCHEMA)


def evaluate_alarms(metrics: DataFrame, specs: list[tuple] | None = None) -> DataFrame:
    """State of every alarm in every period between its metric's first and last datapoint.

    Datapoints reduce to one value per (alarm, period); a calendar row per period makes gaps
    visible, and the M-of-N rule looks at the last N periods of the alarm. From there on a
    partition holds one alarm's periods, which grow with time and not with the datapoints. The spec
    list is given by the caller and tiny, so it is broadcast.
    """
    rows = ALARM_SPECS if specs is None else specs
    longest = max(r[6] for r in rows)
    table = F.broadcast(alarm_specs(metrics.sparkSession, rows))
    at = F.unix_seconds("ts")
    period = F.col("period_seconds").cast("bigint")
    reduced = (
        metrics.join(table, "metric_name")
        .groupBy("alarm_name", (at - F.pmod(at, period)).alias("_at"))
        .agg(
            F.avg("value").alias("_avg"), F.sum("value").alias("_sum"),
            F.max("value").alias("_max"), F.min("value").alias("_min"),
        )
    )
    calendar = (
        reduced.groupBy("alarm_name")
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
        .join(table, "alarm_name")
        .withColumn("_at", F.explode(F.sequence("_from", "_to", period)))
        .drop("_from", "_to")
    )
    joined = calendar.join(reduced, ["alarm_name", "_at"], "left")
    value = F.round(
        F.when(F.col("statistic") == "Average", F.col("_avg"))
        .when(F.col("statistic") == "Sum", F.col("_sum"))
        .when(F.col("statistic") == "Maximum", F.col("_max"))
        .otherwise(F.col("_min")),
        6,
    )
    breach = F.when(F.col("comparison") == ">", F.col("value") > F.col("threshold")).otherwise(
        F.col("value") < F.col("threshold")
    )
    point = (
        F.when(F.col("value").isNotNull(), breach.cast("int"))
        .when(F.col("treat_missing_data") == "breaching", 1)
        .when(F.col("treat_missing_data") == "notBreaching", 0)
        .otherwise(-1)
    )
    last_n = (
        Window.partitionBy("alarm_name").orderBy("_at").rowsBetween(-(longest - 1), Window.currentRow)
    )
    recent = F.collect_list("_point").over(last_n)
    size = F.least(F.col("evaluation_periods"), F.size("_recent"))
    looked_at = F.slice(F.col("_recent"), F.size("_recent") - size + 1, size)
    hits = F.size(F.filter(looked_at, lambda p: p == 1))
    known = F.size(F.filter(looked_at, lambda p: p >= 0))
    return (
        joined.withColumn("value", value)
        .withColumn("_point", point)
        .withColumn("_recent", recent)
        .select(
            "alarm_name", "severity",
            F.timestamp_seconds("_at").alias("period_start"),
            "value", "threshold",
            F.when(hits >= F.col("datapoints_to_alarm"), "ALARM")
            .when(known == 0, "INSUFFICIENT_DATA")
            .otherwise("OK")
            .alias("state"),
        )
    )


def alarm_transitions(states: DataFrame) -> DataFrame:
    """Each change of an alarm's state, with how long the new state lasted (NULL while it lasts)."""
    order = Window.partitionBy("alarm_name").orderBy("period_start")
    changed = states.withColumn("from_state", F.lag("state", 1, "OK").over(order)).filter(
        F.col("from_state") != F.col("state")
    )
    until = F.lead("period_start").over(order)
    return changed.select(
        "alarm_name", "period_start", "from_state", F.col("state").alias("to_state"),
        (F.unix_seconds(until) - F.unix_seconds("period_start")).alias("duration_s"),
    )


def suggest_threshold(states: DataFrame, probability: float = 0.95) -> DataFrame:
    """A percentile of each alarm's values in its OK periods, without an alarm's whole life in one buffer."""
    normal = states.filter((F.col("state") == "OK") & F.col("value").isNotNull())
    found = exact_percentiles(normal, ["alarm_name", "threshold"], "value", {"_p": probability})
    return found.select(
        "alarm_name", "threshold", F.col("n").alias("normal_periods"), F.round("_p", 4).alias("suggested_threshold")
    )
