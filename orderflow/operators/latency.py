"""Latency, throughput and health analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.percentiles import approx_percentiles, exact_percentiles
from orderflow.functions.scalar import join_on, time_bin
from orderflow.operators.rollups import K as SKETCH_K
from orderflow.operators.rollups import with_quantiles

P50_95_99 = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def latency_percentiles(
    df: DataFrame, keys: list[str] | None = None, column: str = "latency_ms", exact: bool = True
) -> DataFrame:
    """p50, p95 and p99 of positive latencies, overall or per key."""
    positive = df.filter(F.col(column) > 0)
    find = exact_percentiles if exact else approx_percentiles
    return find(positive, keys or [], column, P50_95_99)


def latency_by_operator(df: DataFrame, column: str = "latency_ms") -> DataFrame:
    plain = df.groupBy("operator").agg(
        F.round(F.avg(column), 6).alias("avg_latency"), F.max(column).alias("max_latency")
    )
    ranks = exact_percentiles(df, ["operator"], column, {"p95": 0.95, "p99": 0.99}).drop("n")
    return join_on(plain, ranks, ["operator"]).orderBy(F.desc("p99"), "operator")


def latency_by_region(
    df: DataFrame, column: str = "latency_ms", global_ms: int = 5000, region_ms: int = 10000
) -> DataFrame:
    """p99 per region and overall, each against its objective."""
    overall = exact_percentiles(df, [], column, {"p99": 0.99}).withColumn("region", F.lit("(all)"))
    regions = exact_percentiles(df, ["region"], column, {"p99": 0.99})
    limit = F.when(F.col("region") == "(all)", global_ms).otherwise(region_ms)
    return regions.unionByName(overall).withColumn("breach", F.col("p99") > limit)


def enrichment_health(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Average lookup latency and cache-hit rate per minute of the enrichment operator."""
    return (
        df.filter(F.col("operator") == "enrichment")
        .groupBy(F.date_trunc("minute", ts).alias("minute"))
        .agg(
            F.round(F.avg("context.api_latency_ms"), 6).alias("api_latency"),
            F.round(F.avg(F.col("context.cache_hit").cast("int")), 6).alias("cache_hit_rate"),
        )
    )


def slow_requests(df: DataFrame, above_ms: int = 2000, n: int = 20) -> DataFrame:
    """The first ``n`` slow enrichment requests."""
    return (
        df.filter(
            (F.col("operator") == "enrichment") & (F.col("context.api_latency_ms") > above_ms)
        )
        .select("timestamp", "order_id", "customer_id", F.col("context.api_latency_ms").alias("api_latency_ms"))
        .orderBy("timestamp", "order_id")
        .limit(n)
    )


def slow_request_customers(df: DataFrame, above_ms: int = 2000) -> DataFrame:
    """Which customers the slow requests belong to, and their share."""
    slow = df.filter(
        (F.col("operator") == "enrichment") & (F.col("context.api_latency_ms") > above_ms)
    )
    counts = slow.groupBy("customer_id").agg(F.count("*").alias("slow_count"))
    total = counts.agg(F.sum("slow_count")).scalar()
    return counts.withColumn("percent", F.round(F.col("slow_count") * 100.0 / total, 4))


def throughput_in_out(
    records_in: DataFrame, records_out: DataFrame, keys: list[str], in_ts: str, out_ts: str
) -> DataFrame:
    """Records in and out per minute (and key); ``behind`` when fewer came out than went in."""

    def count(df: DataFrame, ts: str, n_in: int) -> DataFrame:
        return df.select(
            *keys, F.date_trunc("minute", ts).alias("minute"),
            F.lit(n_in).alias("_in"), F.lit(1 - n_in).alias("_out"),
        )

    return (
        count(records_in, in_ts, 1)
        .unionByName(count(records_out, out_ts, 0))
        .groupBy(*keys, "minute")
        .agg(F.sum("_in").alias("records_in"), F.sum("_out").alias("records_out"))
        .withColumn("behind", F.col("records_out") < F.col("records_in"))
    )


# Objective ladders (yellow, orange, red above).
SLO_LADDERS = {
    "latency_p99_ms": (3000, 5000, 8000),
    "consumer_lag_records": (5000, 10000, 20000),
}


def slo_status(df: DataFrame, metric: str = "metric_name", value: str = "value") -> DataFrame:
    """Colour of each value on its metric's ladder; metrics without one are left out."""
    status = None
    for name, (yellow, orange, red) in SLO_LADDERS.items():
        ladder = (
            F.when(F.col(value) >= red, "red")
            .when(F.col(value) >= orange, "orange")
            .when(F.col(value) >= yellow, "yellow")
            .otherwise("green")
        )
        hit = F.col(metric) == name
        status = F.when(hit, ladder) if status is None else status.when(hit, ladder)
    return df.filter(F.col(metric).isin(*SLO_LADDERS)).withColumn("slo", status)


def health_score(minutes: DataFrame) -> DataFrame:
    """Green, Yellow or Red per minute from ``lag``, ``dlq_rate``, ``checkpoint_failures``,
    ``p99_ms`` and ``completeness``. Red wins; a missing signal does not count against health."""

    def known(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    red = (
        known(F.col("lag") > 50000) | known(F.col("dlq_rate") > 100)
        | known(F.col("checkpoint_failures") > 0) | known(F.col("p99_ms") > 5000)
        | known(F.col("completeness") < 90)
    )
    yellow = (
        known(F.col("lag") >= 10000) | known(F.col("dlq_rate") >= 10)
        | known(F.col("p99_ms") >= 3000) | known(F.col("completeness") <= 95)
    )
    return minutes.withColumn(
        "health", F.when(red, "Red").when(yellow, "Yellow").otherwise("Green")
    )


# Days each class of metric is kept.
RETENTION_DAYS = {"latency": 1, "resource": 7, "throughput": 30, "errors": 30, "checkpoints": 30}


def metric_rollup(
    df: DataFrame, now: Column, classes: dict[str, str], ts: str = "ts", keep_raw_days: int = 1
) -> DataFrame:
    """Per-minute averages and percentiles, and the retention cut by metric class.

    Points past their class's retention are left out, but latency points past it survive as
    per-minute percentiles for 30 days, as every class's averages do. ``sketch`` answers other quantiles and
    merges to longer times (:mod:`orderflow.operators.rollups`).
    """
    mapping = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    age_days = (F.unix_seconds(now) - F.unix_seconds(ts)) / 86400
    tagged = df.withColumn("metric_class", mapping[F.col("metric_name")])
    days = F.create_map(*[F.lit(x) for pair in RETENTION_DAYS.items() for x in pair])
    kept_days = F.when(F.col("metric_class") == "latency", 30).otherwise(days[F.col("metric_class")])
    rows = (
        tagged.filter((age_days <= kept_days) & (age_days >= 0))
        .groupBy("metric_name", "metric_class", F.date_trunc("minute", ts).alias("minute"))
        .agg(
            F.count("*").alias("points"),
            F.round(F.avg("value"), 6).alias("avg_value"),
            F.max("value").alias("max_value"),
            F.max(age_days <= keep_raw_days).alias("raw_kept"),
            F.kll_sketch_agg_double("value", SKETCH_K).alias("sketch"),
        )
    )
    return with_quantiles(rows)


# Fixed values: (metric, direction, warning from, critical beyond). Direction "low" is bad when small.
METRIC_GRADES = [
    ("consumer_lag_records", "high", 10000.0, 50000.0),
    ("DLQRecordCount", "high", 10.0, 100.0),
    ("LatencyP99", "high", 3000.0, 5000.0),
    ("WindowCompleteness", "low", 99.0, 95.0),
    ("memory_usage_percentage", "high", 70.0, 85.0),
    ("cpu_usage_percentage", "high", 70.0, 90.0),
    ("checkpoint_duration_ms", "high", 10000.0, 30000.0),
    ("checkpoint_failures_total", "high", None, 0.0),
    ("kafka_broker_alive_count", "low", 2.0, 2.0),
    ("firehose_failed_put_count", "high", None, 0.0),
]


def metric_status(df: DataFrame, metric: str = "metric_name", value: str = "value") -> DataFrame:
    """Grade each value normal, warning or critical by the ten-row table above."""
    spark = df.sparkSession
    grades = spark.createDataFrame(
        METRIC_GRADES, f"{metric} string, direction string, warn double, crit double"
    )
    joined = df.join(F.broadcast(grades), metric)
    v = F.col(value)
    high = F.col("direction") == "high"
    critical = (high & (v > F.col("crit"))) | (~high & (v < F.col("crit")))
    warning = (high & (v >= F.col("warn"))) | (~high & (v <= F.col("warn")))
    return joined.withColumn(
        "grade",
        F.when(critical, "critical").when(F.coalesce(warning, F.lit(False)), "warning").otherwise("normal"),
    ).drop("direction", "warn", "crit")


def metric_trend(
    df: DataFrame, ts: str = "ts", flat_share: float = 0.05, metric: str = "metric_name"
) -> DataFrame:
    """Slope per hour and first/last average per metric; "growing" when the line gains more than
    ``flat_share`` of the mean over the span."""
    # Hours since the epoch, centred on 2024 to keep the sums well conditioned.
    hours = (F.unix_micros(ts) - F.lit(1704067200000000)) / 3.6e9
    fitted = df.withColumn("_h", hours).groupBy(metric).agg(
        F.count("*").alias("points"),
        F.regr_slope("value", "_h").alias("_slope"),
        F.avg("value").alias("_mean"),
        F.min_by("value", F.struct(ts, "value")).alias("first_value"),
        F.max_by("value", F.struct(ts, "value")).alias("last_value"),
        (F.max("_h") - F.min("_h")).alias("_span"),
    )
    gain = F.col("_slope") * F.col("_span")
    limit = F.abs("_mean") * flat_share
    return fitted.select(
        metric,
        "points",
        F.round("_slope", 4).alias("slope_per_hour"),
        "first_value",
        "last_value",
        F.when(gain > limit, "growing").when(gain < -limit, "falling").otherwise("stable").alias("trend"),
    )


def metric_correlation(
    df: DataFrame, target: str, others: list[str], seconds: int = 60, ts: str = "ts"
) -> DataFrame:
    """Correlation of each other metric's per-bin average with the target's, over shared bins."""
    names = [target, *others]
    wide = df.filter(F.col("metric_name").isin(*names)).groupBy(
        time_bin(F.col(ts), seconds).alias("_bin")
    ).agg(
        *[
            F.avg(F.when(F.col("metric_name") == n, F.col("value"))).alias(f"_m{i}")
            for i, n in enumerate(names)
        ]
    )
    pairs = []
    for i in range(1, len(names)):
        both = F.col("_m0").isNotNull() & F.col(f"_m{i}").isNotNull()
        pairs.append(F.corr(F.when(both, F.col("_m0")), F.when(both, F.col(f"_m{i}"))).alias(f"_c{i}"))
        pairs.append(F.count_if(both).alias(f"_n{i}"))
    one = wide.agg(*pairs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("metric_name"),
                    F.col(f"_n{i}").alias("shared_bins"),
                    F.round(f"_c{i}", 4).alias("correlation"),
                )
                for i, n in enumerate(names)
                if i
            ]
        )
    )
    return one.select(rows.alias("_r")).select("_r.*")
