"""Error, latency, throughput, quality, lag and alarm queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.functions.scalar import region_of
from orderflow.operators import alarms as A
from orderflow.operators import dedup as D
from orderflow.operators import distincts as T
from orderflow.operators import errors as O
from orderflow.operators import lag as G
from orderflow.operators import late as L
from orderflow.operators import latency as Y
from orderflow.operators import quality as Q
from orderflow.operators import rollups as R
from orderflow.operators import validate as V
from orderflow.operators import windows as W
from orderflow.plans import inputs as I
from orderflow.plans.oracle import percentile, sql
from orderflow.plans.registry import query
from orderflow.sources.digests import DigestedTable, digest_difference, unequal_places

_FOUR = ["parse_error", "duplicate", "validation_error", "timeout"]
_THREE = ["parse_error", "validation_error", "timeout"]


def _in(types):
    return "(" + ",".join(f"'{t}'" for t in types) + ")"


def _round6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _dlq(spark, sf):
    """Dead letters with their arrival as error time and their name in logs."""
    bad = V.route(I.validated(spark, sf))[1]
    return V.map_error_types(bad).withColumn("error_timestamp", F.col("arrival_ts"))


# --- errors -----------------------------------------------------------------------------------


@query("O1_errors_by_type", sql(f"SELECT error_type, count(*) AS error_count FROM logs WHERE error_type IN {_in(_FOUR)} GROUP BY 1"))
def errors_by_type(spark, sf):
    return O.errors_by_type(I.log_events(spark, sf), _FOUR)


@query(
    "O2_error_share",
    sql(
        "SELECT error_type, error_count, round(error_count * 100.0::DOUBLE / sum(error_count) OVER (), 2) AS percent,"
        " round(error_count * 100.0::DOUBLE / sum(error_count) OVER (), 2) > 80 AS is_dominant"
        " FROM (SELECT error_type, count(*) AS error_count FROM logs WHERE error_type IS NOT NULL GROUP BY 1)"
    ),
)
def error_share(spark, sf):
    return O.error_share(I.log_events(spark, sf))


@query(
    "O3_dlq_rate_per_minute",
    sql(
        "SELECT date_trunc('minute', arrival_ts) AS minute, count(*) AS dlq_count, CASE WHEN count(*) > 100 THEN 'red' WHEN count(*) >= 10 THEN 'yellow' ELSE 'normal' END AS level"
        " FROM checked WHERE error_type IS NOT NULL GROUP BY 1"
    ),
)
def dlq_rate_per_minute(spark, sf):
    return O.dlq_rate_per_minute(_dlq(spark, sf))


@query(
    "O4_dlq_by_type_per_minute",
    sql(
        "SELECT date_trunc('minute', arrival_ts) AS minute, count(*) FILTER (error_type = 'SCHEMA_INVALID') AS parse_error,"
        " count(*) FILTER (error_type = 'BUSINESS_RULE_VIOLATION') AS validation_error, 0::BIGINT AS duplicate, 0::BIGINT AS timeout, 0::BIGINT AS external_api_error"
        " FROM checked WHERE error_type IS NOT NULL GROUP BY 1"
    ),
)
def dlq_by_type_per_minute(spark, sf):
    return O.dlq_by_type_per_minute(_dlq(spark, sf))


@query(
    "O5_top_error_orders",
    sql("SELECT order_id, count(*) AS error_count FROM logs WHERE error_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
)
def top_error_orders(spark, sf):
    return O.top_error_orders(I.log_events(spark, sf))


@query(
    "O6_timeout_trend",
    sql("SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS bin_start, count(*) AS timeout_count FROM logs WHERE error_type = 'timeout' GROUP BY 1"),
)
def timeout_trend(spark, sf):
    return O.timeout_trend(I.log_events(spark, sf))


@query("O7_errors_by_operator", sql("SELECT operator, count(*) AS error_count FROM logs WHERE level = 'ERROR' GROUP BY 1"))
def errors_by_operator(spark, sf):
    return O.errors_by_operator(I.log_events(spark, sf))


@query(
    "O8_dlq_spike_cause",
    sql(
        f"SELECT time_bucket(INTERVAL 1 DAY, timestamp) AS bin_start, error_type, count(*) AS error_count FROM logs WHERE error_type IN {_in(_THREE)}"
        " GROUP BY 1, 2 HAVING count(*) > 10"
    ),
)
def dlq_spike_cause(spark, sf):
    """Bins of a day, since the given events are sparse."""
    return O.dlq_spike_cause(I.log_events(spark, sf), _THREE, seconds=86400, above=10)


@query(
    "O9_recent_errors",
    sql(
        f"SELECT error_type, count(*) AS error_count FROM logs WHERE error_type IN {_in(_THREE)}"
        " AND timestamp > (SELECT max(timestamp) FROM logs) - INTERVAL 1 DAY - to_microseconds((SELECT epoch_us(max(timestamp)) % 1000000 FROM logs)) GROUP BY 1"
    ),
)
def recent_errors(spark, sf):
    logs = I.log_events(spark, sf)
    return O.recent_errors(logs, I.newest(logs, "timestamp"), _THREE, seconds=86400)


@query(
    "O10_trace_order",
    sql(
        "SELECT timestamp, order_id, operator, latency_ms, status, message FROM logs WHERE order_id ="
        " (SELECT order_id FROM logs WHERE error_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    ),
)
def trace_order(spark, sf):
    """The order with the most errors, found first and then traced."""
    logs = I.log_events(spark, sf)
    worst = O.top_error_orders(logs, 1).select("order_id").scalar()
    return O.trace_order(logs, worst)


# --- latency and throughput -------------------------------------------------------------------


@query(
    "O11_latency_percentiles",
    sql(
        f"SELECT count(*) AS n, {percentile('latency_ms', .5)} AS p50, {percentile('latency_ms', .95)} AS p95, {percentile('latency_ms', .99)} AS p99"
        " FROM logs WHERE latency_ms > 0"
    ),
)
def latency_percentiles(spark, sf):
    return _round6(Y.latency_percentiles(I.log_table(spark, sf)), "p50", "p95", "p99")


@query(
    "O11_latency_percentiles_fractions",
    sql(
        f"SELECT metric_name, count(*) AS n, {percentile('value', .5)} AS p50, {percentile('value', .95)} AS p95, {percentile('value', .99)} AS p99"
        " FROM metrics WHERE value > 0 GROUP BY 1"
    ),
)
def latency_percentiles_fractions(spark, sf):
    """The same of doubles with fractions, per metric."""
    return _round6(Y.latency_percentiles(I.metrics(spark, sf), ["metric_name"], "value"), "p50", "p95", "p99")


@query(
    "O11_latency_percentiles_per_minute",
    sql(
        f"SELECT date_trunc('minute', timestamp) AS minute, count(*) AS n, {percentile('latency_ms', .5)} AS p50, {percentile('latency_ms', .95)} AS p95,"
        f" {percentile('latency_ms', .99)} AS p99 FROM logs WHERE latency_ms > 0 GROUP BY 1"
    ),
)
def latency_percentiles_per_minute(spark, sf):
    logs = I.log_table(spark, sf).withColumn("minute", F.date_trunc("minute", "timestamp"))
    return _round6(Y.latency_percentiles(logs, ["minute"]), "p50", "p95", "p99")


@query(
    "O12_latency_by_operator",
    sql(
        f"SELECT operator, round(avg(latency_ms), 6) AS avg_latency, max(latency_ms) AS max_latency, {percentile('latency_ms', .95)} AS p95,"
        f" {percentile('latency_ms', .99)} AS p99 FROM (SELECT * REPLACE (CASE WHEN customer_id NOT LIKE '%7' THEN operator END AS operator) FROM logs) GROUP BY 1"
    ),
)
def latency_by_operator(spark, sf):
    """Some events name no operator."""
    unnamed = F.when(~F.col("customer_id").endswith("7"), F.col("operator"))
    return _round6(Y.latency_by_operator(I.log_table(spark, sf).withColumn("operator", unnamed)), "p95", "p99")


@query(
    "O13_latency_by_region",
    sql(
        "SELECT region, n, p99, p99 > CASE WHEN region = '(all)' THEN 5000 ELSE 10000 END AS breach FROM ("
        f" SELECT coalesce(region, '(all)') AS region, count(*) AS n, {percentile('latency_ms', .99)} AS p99 FROM ("
        "  SELECT latency_ms, CASE WHEN lower(split_part(customer_id, '-', 2)) IN ('us','eu','uk','ca','au') THEN lower(split_part(customer_id, '-', 2)) ELSE 'ca' END AS region FROM logs)"
        " GROUP BY GROUPING SETS ((region), ()))"
    ),
)
def latency_by_region(spark, sf):
    logs = I.log_table(spark, sf).withColumn("region", region_of(F.col("customer_id")))
    return _round6(Y.latency_by_region(logs), "p99")


@query(
    "O14_enrichment_health",
    sql(
        "SELECT date_trunc('minute', timestamp) AS minute, round(avg(api_latency_ms), 6) AS api_latency, round(avg(cache_hit::INT), 6) AS cache_hit_rate"
        " FROM logs WHERE operator = 'enrichment' GROUP BY 1"
    ),
)
def enrichment_health(spark, sf):
    return Y.enrichment_health(I.log_events(spark, sf))


@query(
    "O15_slow_requests",
    sql("SELECT timestamp, order_id, customer_id, api_latency_ms FROM logs WHERE operator = 'enrichment' AND api_latency_ms > 2000 ORDER BY timestamp, order_id LIMIT 20"),
)
def slow_requests(spark, sf):
    return Y.slow_requests(I.log_events(spark, sf))


@query(
    "O15_slow_request_customers",
    sql(
        "SELECT customer_id, slow_count, round(slow_count * 100.0::DOUBLE / sum(slow_count) OVER (), 4) AS percent FROM ("
        " SELECT customer_id, count(*) AS slow_count FROM logs WHERE operator = 'enrichment' AND api_latency_ms > 1000 GROUP BY 1)"
    ),
)
def slow_request_customers(spark, sf):
    return Y.slow_request_customers(I.log_events(spark, sf), above_ms=1000)


@query(
    "O16_throughput_in_out",
    sql(
        "SELECT date_trunc('minute', arrival_ts) AS minute, count(*) AS records_in, count(*) FILTER (error_type IS NULL) AS records_out,"
        " count(*) FILTER (error_type IS NULL) < count(*) AS behind FROM checked GROUP BY 1"
    ),
)
def throughput_in_out(spark, sf):
    return Y.throughput_in_out(
        I.raw_orders(spark, sf), I.valid_orders(spark, sf), [], "arrival_ts", "arrival_ts"
    )


@query(
    "O16_throughput_by_operator",
    sql(
        "SELECT operator, date_trunc('minute', timestamp) AS minute, count(*) AS records_in, count(*) FILTER (status = 'success') AS records_out,"
        " count(*) FILTER (status = 'success') < count(*) AS behind FROM logs GROUP BY 1, 2"
    ),
)
def throughput_by_operator(spark, sf):
    logs = I.log_events(spark, sf)
    return Y.throughput_in_out(
        logs, logs.filter(F.col("status") == "success"), ["operator"], "timestamp", "timestamp"
    )


@query(
    "O17_slo_status",
    sql(
        "SELECT event_id, metric_name, value, CASE metric_name WHEN 'latency_p99_ms' THEN"
        " CASE WHEN value >= 8000 THEN 'red' WHEN value >= 5000 THEN 'orange' WHEN value >= 3000 THEN 'yellow' ELSE 'green' END ELSE"
        " CASE WHEN value >= 20000 THEN 'red' WHEN value >= 10000 THEN 'orange' WHEN value >= 5000 THEN 'yellow' ELSE 'green' END END AS slo"
        " FROM (SELECT event_id, value, CASE WHEN metric_name = 'LatencyP99' THEN 'latency_p99_ms' ELSE metric_name END AS metric_name FROM metrics)"
        " WHERE metric_name IN ('latency_p99_ms', 'consumer_lag_records')"
    ),
)
def slo_status(spark, sf):
    name = F.when(F.col("metric_name") == "LatencyP99", "latency_p99_ms").otherwise(F.col("metric_name"))
    return Y.slo_status(I.metrics(spark, sf).withColumn("metric_name", name)).select(
        "event_id", "metric_name", "value", "slo"
    )


def _signals(spark, sf):
    def of(name):
        return F.when(F.col("metric_name") == name, F.col("value"))

    return (
        I.metrics(spark, sf)
        .groupBy(F.date_trunc("minute", "ts").alias("minute"))
        .agg(
            F.max(of("consumer_lag_records")).alias("lag"),
            F.sum(of("DLQRecordCount")).alias("dlq_rate"),
            F.sum(of("checkpoint_failures_total")).alias("checkpoint_failures"),
            F.max(of("LatencyP99")).alias("p99_ms"),
            F.min(of("WindowCompleteness")).alias("completeness"),
        )
    )


@query(
    "O18_health_score",
    sql(
        "SELECT minute, CASE WHEN coalesce(lag > 50000, false) OR coalesce(dlq > 100, false) OR coalesce(fail > 0, false) OR coalesce(p99 > 5000, false) OR coalesce(comp < 90, false) THEN 'Red'"
        " WHEN coalesce(lag >= 10000, false) OR coalesce(dlq >= 10, false) OR coalesce(p99 >= 3000, false) OR coalesce(comp <= 95, false) THEN 'Yellow' ELSE 'Green' END AS health FROM ("
        " SELECT date_trunc('minute', ts) AS minute, max(value) FILTER (metric_name = 'consumer_lag_records') AS lag, sum(value) FILTER (metric_name = 'DLQRecordCount') AS dlq,"
        " sum(value) FILTER (metric_name = 'checkpoint_failures_total') AS fail, max(value) FILTER (metric_name = 'LatencyP99') AS p99,"
        " min(value) FILTER (metric_name = 'WindowCompleteness') AS comp FROM metrics GROUP BY 1)"
    ),
)
def health_score(spark, sf):
    return Y.health_score(_signals(spark, sf)).select("minute", "health")


_CLASSES = {
    "DLQRecordCount": "errors", "DuplicateRecordDetected": "errors",
    "kafka_deserialization_errors_total": "errors", "firehose_failed_put_count": "errors",
    "checkpoint_failures_total": "checkpoints", "checkpoint_duration_ms": "checkpoints",
    "consumer_lag_records": "throughput", "WindowCompleteness": "throughput",
    "LatencyP99": "latency", "memory_usage_percentage": "resource",
    "kafka_broker_alive_count": "resource",
}


def _disc(value: str, p: float) -> str:
    """SQL: the least value that at least the share ``p`` of a group's rows do not exceed."""
    return f"list_sort(list({value}))[greatest(1, ceil({p} * count(*)))::INT]"


_MINUTE_P = ", ".join(f"{_disc('value', p)} AS {name}" for name, p in R.P50_95_99.items())


@query(
    "O19_metric_rollup",
    sql(
        "SELECT metric_name, metric_class, date_trunc('minute', ts) AS minute, count(*) AS points, round(avg(value), 6) AS avg_value, max(value) AS max_value,"
        f" bool_or(age <= 86400) AS raw_kept, {_MINUTE_P} FROM ("
        " SELECT *, CASE " + " ".join(f"WHEN metric_name = '{k}' THEN '{v}'" for k, v in _CLASSES.items()) + " END AS metric_class,"
        " epoch_us(date_trunc('second', (SELECT max(ts) FROM metrics))) // 1000000 - epoch_us(date_trunc('second', ts)) // 1000000 AS age FROM metrics)"
        " WHERE age <= 86400 * CASE metric_class WHEN 'resource' THEN 7 ELSE 30 END GROUP BY 1, 2, 3"
    ),
)
def metric_rollup(spark, sf):
    m = I.metrics(spark, sf)
    return Y.metric_rollup(m, I.newest(m, "ts"), _CLASSES).drop("sketch")


def _minute_sketches(spark, sf):
    """What outlives the raw points: a table of minute rollups."""
    return I.staged(R.rollup(I.metrics(spark, sf), ["metric_name"], "ts", "value"), "minute-sketches")


@query(
    "O19_rollup_by_hour",
    sql(
        f"SELECT metric_name, date_trunc('hour', ts) AS start, count(*) AS n, min(value) AS low, max(value) AS high, {_MINUTE_P}"
        " FROM metrics GROUP BY 1, 2"
    ),
)
def rollup_by_hour(spark, sf):
    """Hours from the sketches of their minutes, read after the raw points are gone; hours have fewer points than a sketch, so the answers are exact."""
    hours = R.coarser(_minute_sketches(spark, sf), ["metric_name"], "hour")
    return R.with_quantiles(hours).drop("sketch", "total")


@query(
    "O19_rollup_rank_error",
    sql("SELECT metric_name, count(*) AS n, true AS p50_near, true AS p95_near, true AS p99_near FROM metrics GROUP BY 1"),
)
def rollup_rank_error(spark, sf):
    """The whole time from minutes to hours to days to all: whether the rank of each answer among the raw points is within the stated error."""
    rolled = _minute_sketches(spark, sf)
    for unit in ("hour", "day", None):
        rolled = R.coarser(rolled, ["metric_name"], unit)
    return R.rank_checked(rolled, I.metrics(spark, sf), ["metric_name"], "value")


@query(
    "O11_latency_sketches",
    sql(
        "SELECT operator, date_trunc('hour', timestamp) AS start, count(*) AS n, " + ", ".join(f"{_disc('latency_ms', p)}::DOUBLE AS {name}" for name, p in R.P50_95_99.items())
        + " FROM logs WHERE latency_ms > 0 GROUP BY 1, 2"
    ),
)
def latency_sketches(spark, sf):
    """Latency percentiles per operator and hour, merged from stored minutes."""
    positive = I.log_events(spark, sf).filter("latency_ms > 0")
    minutes = I.staged(R.rollup(positive, ["operator"], "timestamp", "latency_ms"), "latency-sketches")
    return R.with_quantiles(R.coarser(minutes, ["operator"], "hour")).select("operator", "start", "n", *R.P50_95_99)


@query(
    "O20_metric_status",
    sql(
        "SELECT event_id, metric_name, value, CASE WHEN (hi AND value > crit) OR (NOT hi AND value < crit) THEN 'critical'"
        " WHEN coalesce((hi AND value >= warn) OR (NOT hi AND value <= warn), false) THEN 'warning' ELSE 'normal' END AS grade FROM metrics JOIN (VALUES "
        "('consumer_lag_records', true, 10000, 50000), ('DLQRecordCount', true, 10, 100), ('LatencyP99', true, 3000, 5000),"
        " ('WindowCompleteness', false, 99, 95), ('memory_usage_percentage', true, 70, 85), ('cpu_usage_percentage', true, 70, 90),"
        " ('checkpoint_duration_ms', true, 10000, 30000), ('checkpoint_failures_total', true, NULL, 0),"
        " ('kafka_broker_alive_count', false, 2, 2), ('firehose_failed_put_count', true, NULL, 0)"
        + ") g(name, hi, warn, crit) ON name = metric_name"
    ),
)
def metric_status(spark, sf):
    return Y.metric_status(I.metrics(spark, sf)).select("event_id", "metric_name", "value", "grade")


@query(
    "O21_metric_trend",
    sql(
        "SELECT metric_name, points, round(slope, 4) AS slope_per_hour, first_value, last_value,"
        " CASE WHEN slope * span > abs(mean) * 0.05 THEN 'growing' WHEN slope * span < -abs(mean) * 0.05 THEN 'falling' ELSE 'stable' END AS trend FROM ("
        " SELECT metric_name, count(*) AS points, regr_slope(value, h) AS slope, avg(value) AS mean, min_by(value, (ts, value)) AS first_value,"
        " max_by(value, (ts, value)) AS last_value, max(h) - min(h) AS span FROM (SELECT *, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS h FROM metrics) GROUP BY 1)"
    ),
)
def metric_trend(spark, sf):
    return Y.metric_trend(I.metrics(spark, sf))


_OTHERS = ["consumer_lag_records", "memory_usage_percentage", "checkpoint_duration_ms"]


@query(
    "O22_metric_correlation",
    sql(
        "SELECT o.name AS metric_name, count(*) AS shared_bins, round(corr(t.a, o.a), 4) AS correlation FROM"
        " (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS b, avg(value) AS a FROM metrics WHERE metric_name = 'LatencyP99' GROUP BY 1) t JOIN"
        f" (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS b, metric_name AS name, avg(value) AS a FROM metrics WHERE metric_name IN {_in(_OTHERS)} GROUP BY 1, 2) o"
        " ON o.b = t.b GROUP BY 1"
    ),
)
def metric_correlation(spark, sf):
    return Y.metric_correlation(I.metrics(spark, sf), "LatencyP99", _OTHERS, seconds=6 * 3600)


# --- completeness, reconciliation -------------------------------------------------------------

_W5 = "time_bucket(INTERVAL 5 MINUTE, event_time)"


@query(
    "Q1_window_completeness",
    sql(
        "SELECT window_start, count(*) AS entered, count(*) FILTER (NOT is_late) AS emitted, round(count(*) FILTER (NOT is_late) * 100.0::DOUBLE / count(*), 4) AS completeness,"
        " round(count(*) FILTER (NOT is_late) * 100.0::DOUBLE / count(*), 4) < 95 AS breach FROM late GROUP BY 1"
    ),
)
def window_completeness(spark, sf):
    """Rows that entered each window against the rows its metrics were computed from."""
    columns = ["event_time", "region", "amount"]
    judged = I.staged(L.flag_late(I.processed_orders(spark, sf, columns=columns)), "judged")
    emitted = W.window_accumulate(judged.filter(~F.col("is_late")), ["region"])
    return Q.window_completeness(judged, emitted).withColumn(
        "emitted", F.col("emitted").cast("bigint")
    )


def _judged(flagged):
    """Rows with ``is_late`` among those that are no duplicates, NULL for the duplicates; one pass."""
    unique, repeated = flagged.filter(~F.col("is_dup")), flagged.filter("is_dup")
    late = L.flag_late(unique).drop("seen_before", "window_end")
    return late.unionByName(repeated.withColumn("is_late", F.lit(None).cast("boolean")))


@query(
    "Q2_unaccounted_per_window",
    sql(
        "SELECT window_start, count(*) AS records_in, count(*) FILTER (NOT is_late AND NOT is_dup) AS records_out, count(*) FILTER (is_late) AS records_late,"
        " count(*) FILTER (is_dup AND NOT coalesce(is_late, false)) AS unaccounted, count(*) FILTER (is_dup AND NOT coalesce(is_late, false)) <> 0 AS is_error FROM ("
        f" SELECT f.is_dup, l.is_late, {_W5.replace('event_time', 'f.event_time')} AS window_start FROM flagged f LEFT JOIN late l USING (order_id, arrival_seq)) GROUP BY 1"
    ),
)
def unaccounted_per_window(spark, sf):
    """Without a count of duplicates they show up as unaccounted rows."""
    judged = _judged(I.flagged_orders(spark, sf, columns=["event_time"]))
    return Q.unaccounted_of_flags(judged, late=F.col("is_late"), out=~F.col("is_late"))


@query(
    "Q3_late_per_window",
    sql(
        "SELECT window_start, rows_in, rows_late, round(rows_late * 100.0::DOUBLE / rows_in, 4) AS late_percent, round(rows_late * 100.0::DOUBLE / rows_in, 4) > 5 AS breach FROM ("
        " SELECT window_start, count(*) AS rows_in, count(*) FILTER (is_late) AS rows_late FROM late GROUP BY 1) WHERE rows_late > 0"
    ),
)
def late_per_window(spark, sf):
    return Q.late_per_window(L.flag_late(I.processed_orders(spark, sf, columns=["event_time"])))


def _missing(table, ts, step, name):
    return (
        f"SELECT t AS {name} FROM (SELECT unnest(generate_series(min(b), max(b), INTERVAL {step})) AS t FROM"
        f" (SELECT time_bucket(INTERVAL {step}, {ts}) AS b FROM {table})) WHERE t NOT IN (SELECT time_bucket(INTERVAL {step}, {ts}) FROM {table})"
    )


@query("Q4_missing_windows", sql(_missing("processed", "event_time", "5 MINUTE", "window_start")))
def missing_windows(spark, sf):
    return Q.missing_windows(W.window_accumulate(I.processed_orders(spark, sf, columns=["event_time", "region", "amount"]), ["region"]))


@query(
    "Q5_conservation",
    sql(
        "SELECT bin_start, records_in, records_out, records_dlq, records_late, records_in >= records_out AS in_covers_out,"
        " records_out = records_in - records_dlq - records_late AS conserved FROM ("
        " SELECT time_bucket(INTERVAL 5 MINUTE, c.arrival_ts) AS bin_start, count(*) AS records_in, count(*) FILTER (NOT l.is_late) AS records_out,"
        " count(*) FILTER (c.error_type IS NOT NULL OR f.is_dup) AS records_dlq, count(*) FILTER (l.is_late) AS records_late"
        " FROM checked c LEFT JOIN flagged f USING (order_id, arrival_seq) LEFT JOIN late l USING (order_id, arrival_seq) GROUP BY 1)"
    ),
)
def conservation(spark, sf):
    """Every raw record is on time, late, rejected or a duplicate."""
    columns = ["order_id", "arrival_seq", "arrival_ts", "event_time", "error_type"]
    checked = I.staged(I.validated(spark, sf).select(*columns), "checked")
    valid, rejected = V.route(checked)
    judged = _judged(D.flag_duplicates(valid))
    rows = judged.unionByName(
        rejected.withColumns({"is_dup": F.lit(None).cast("boolean"), "is_late": F.lit(None).cast("boolean")})
    )
    return Q.conservation_of_flags(
        rows, late=F.col("is_late"), out=~F.col("is_late"), dlq=F.col("error_type").isNotNull() | F.col("is_dup")
    )


@query("Q6_uniqueness", sql("SELECT count(*) AS total, count(DISTINCT order_id) AS distinct_keys, count(*) = count(DISTINCT order_id) AS is_unique FROM processed"))
def uniqueness(spark, sf):
    """Orders re-sent after the memory has expired are accepted again, so this reports them."""
    return Q.uniqueness(I.processed_orders(spark, sf, columns=[]))


@query(
    "Q7_dedup_ratio",
    sql(
        "SELECT count(*) AS rows_in, count(*) FILTER (is_dup) AS duplicates, round(count(*) FILTER (is_dup) * 100.0::DOUBLE / count(*), 4) AS dup_percent,"
        " round(count(*) FILTER (is_dup) * 100.0::DOUBLE / count(*), 4) > 1 AS breach FROM flagged"
    ),
)
def dedup_ratio(spark, sf):
    return Q.dedup_ratio(I.flagged_orders(spark, sf, columns=[]))


@query(
    "Q8_reconcile_counts",
    sql(
        "SELECT hour, source_rows, sink_rows, rejected_rows, source_rows = sink_rows + rejected_rows AS matched FROM ("
        " SELECT date_trunc('hour', c.arrival_ts) AS hour, count(*) AS source_rows, count(*) FILTER (NOT f.is_dup) AS sink_rows, count(*) FILTER (c.error_type IS NOT NULL) AS rejected_rows"
        " FROM checked c LEFT JOIN flagged f USING (order_id, arrival_seq) GROUP BY 1)"
    ),
)
def reconcile_counts(spark, sf):
    checked = I.checked_table(spark, sf)
    return Q.reconcile_counts(
        checked, I.processed_orders(spark, sf, checked), V.route(checked)[1]
    )


@query(
    "Q9_reconcile_totals",
    "SELECT day, source_rows, sink_rows, CAST(st AS DOUBLE) AS source_total, CAST(kt AS DOUBLE) AS sink_total,"
    " round(CAST(kt AS DOUBLE) * 100.0 / nullif(CAST(st AS DOUBLE), 0), 4) AS percent,"
    " coalesce(round(CAST(kt AS DOUBLE) * 100.0 / nullif(CAST(st AS DOUBLE), 0), 4) < 99.9, true) AS alert FROM ("
    " SELECT strftime(d, '%Y-%m-%d') AS day, CAST(sum(s) AS BIGINT) AS source_rows, CAST(sum(1 - s) AS BIGINT) AS sink_rows, sum(CASE WHEN s = 1 THEN a ELSE 0 END) AS st, sum(CASE WHEN s = 0 THEN a ELSE 0 END) AS kt FROM ("
    "  SELECT o_orderdate AS d, 1 AS s, CAST(o_totalprice AS DECIMAL(24,6)) AS a FROM orders UNION ALL"
    "  SELECT o_orderdate, 0, CAST(l_extendedprice AS DECIMAL(24,6)) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1)",
)
def reconcile_totals(spark, sf):
    """Daily totals of the order table against the sum of its items."""
    orders = I.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("amount")
    )
    items = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("amount")
    )
    sink = items.join(orders.select("o_orderkey", "o_orderdate"), "o_orderkey")
    return Q.reconcile_totals(orders, sink, "o_orderdate", "amount")


@query("Q10_hourly_gaps", _missing("events", "ts", "1 HOUR", "hour"))
def hourly_gaps(spark, sf):
    """Hours without a row."""
    return Q.hourly_gaps(I.events(spark, sf), "ts")


@query(
    "Q11_sample_audit",
    sql(
        ", picked AS (SELECT DISTINCT order_id, md5(order_id || '7') AS r FROM valid ORDER BY r LIMIT 100)"
        " SELECT s.order_id, k.n IS NOT NULL AS present, coalesce(k.n, 0) = 1 AS is_unique, coalesce(s.a = k.a AND s.status = k.status, false) AS is_equal, k.n IS NOT NULL AS is_complete FROM"
        " (SELECT order_id, min(amount) AS a, min(status) AS status FROM valid JOIN picked USING (order_id) GROUP BY 1) s LEFT JOIN"
        " (SELECT order_id, count(*) AS n, min(amount) AS a, min(status) AS status FROM processed JOIN picked USING (order_id) GROUP BY 1) k ON s.order_id = k.order_id"
    ),
)
def sample_audit(spark, sf):
    checked = I.checked_table(spark, sf)
    return Q.sample_audit(
        V.route(checked)[0], I.processed_orders(spark, sf, checked), "order_id", ["amount", "status"]
    ).drop("source_copies")


@query(
    "Q12_key_difference",
    sql(
        "SELECT order_id, CASE WHEN n > 0 THEN 'missing_in_sink' ELSE 'extra_in_sink' END AS side, CAST(abs(n) AS BIGINT) AS copies FROM ("
        " SELECT order_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'ORD-' || lpad(o_orderkey::VARCHAR, 9, '0') AS order_id, 1 AS n FROM orders"
        " UNION ALL SELECT order_id, -1 FROM processed) GROUP BY 1) WHERE n <> 0"
    ),
)
def key_difference(spark, sf):
    """The order table against the processed orders, both ways."""
    source = I.table(spark, sf, "orders").select(I.order_id_of(F.col("o_orderkey")).alias("order_id"))
    return Q.key_difference(source, I.processed_orders(spark, sf, columns=[]), "order_id")


def _digested(spark, rows, name):
    table = DigestedTable(spark, I.scratch_path(spark, name), "o_orderkey", buckets=2, period="yyyy-MM")
    table.write(rows.select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate")
    return table


@query(
    "Q12_digest_difference",
    "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 307 = 0 AND o_orderkey % 211 <> 0 THEN 'extra_in_sink' ELSE 'missing_in_sink' END AS side, 1::BIGINT AS copies"
    " FROM orders WHERE o_orderkey % 211 = 0 OR o_orderkey % 307 = 0"
    " UNION ALL SELECT o_orderkey, unnest(['missing_in_sink', 'extra_in_sink']), 1::BIGINT FROM orders"
    " WHERE o_orderkey % 401 = 0 AND o_orderkey % 211 <> 0 AND o_orderkey % 307 <> 0",
)
def digest_difference_of_orders(spark, sf):
    """The order table against a copy that lacks some orders, has some twice and others with another price."""
    orders = I.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    changed = F.when((k % 401 == 0) & (k % 307 != 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = orders.filter(k % 211 != 0).withColumn("o_totalprice", changed)
    sink = kept.unionByName(kept.filter(k % 307 == 0))
    return digest_difference(_digested(spark, orders, "source"), _digested(spark, sink, "sink")).drop("row")


@query(
    "Q12_digest_places",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, 1::BIGINT AS buckets FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) = 1",
)
def digest_places(spark, sf):
    """One order missing, the dearest: what differs, and so is read, is one bucket of one month."""
    orders = I.table(spark, sf, "orders")
    dearest = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey")
    sink = orders.join(dearest, "o_orderkey", "left_anti")
    places = unequal_places(_digested(spark, orders, "source"), _digested(spark, sink, "sink"))
    return spark.createDataFrame([(p[0],) for p in places], "month string").groupBy("month").agg(F.count("*").alias("buckets"))


# --- lag --------------------------------------------------------------------------------------


@query(
    "Q13_consumer_lag",
    sql(
        "SELECT ts, topic, CAST(sum(lag) AS BIGINT) AS total_lag, max(lag) AS max_lag, max_by(partition, lag * 10 - partition) AS slowest_partition FROM ("
        " SELECT *, log_end_offset - current_offset AS lag FROM snaps) GROUP BY 1, 2"
    ),
)
def consumer_lag(spark, sf):
    return G.consumer_lag(I.lag_snapshots(spark, sf))


_TREND = (
    ", per AS (SELECT *, log_end_offset - current_offset AS lag, log_end_offset - current_offset - lag(log_end_offset - current_offset) OVER"
    " (PARTITION BY topic, partition ORDER BY ts) AS lag_change FROM snaps)"
)


@query(
    "Q14_lag_trend",
    sql(
        _TREND + " SELECT topic, partition, ts, lag, coalesce(lag_change, 0) AS lag_change, CASE WHEN lag_change > 1000 THEN 'growing' WHEN lag_change < -1000 THEN 'draining'"
        " WHEN lag_change IS NOT NULL THEN 'stable' ELSE 'first' END AS trend FROM per"
    ),
)
def lag_trend(spark, sf):
    return G.lag_trend(I.lag_snapshots(spark, sf)).withColumn(
        "lag_change", F.coalesce("lag_change", F.lit(0))
    )


@query(
    "Q14_lag_slope",
    sql("SELECT topic, partition, count(*) AS snapshots, round(regr_slope(log_end_offset - current_offset, (epoch_us(ts) // 1000000 - 1704067200) / 3600.0::DOUBLE), 4) AS lag_per_hour FROM snaps GROUP BY 1, 2"),
)
def lag_slope(spark, sf):
    return G.lag_slope(I.lag_snapshots(spark, sf))


@query(
    "Q15_offset_regression",
    sql(
        "SELECT topic, partition, ts, previous_offset, current_offset, previous_offset - current_offset AS replayed FROM ("
        " SELECT *, lag(current_offset) OVER (PARTITION BY topic, partition ORDER BY ts) AS previous_offset FROM snaps) WHERE current_offset < previous_offset"
    ),
)
def offset_regression(spark, sf):
    return G.offset_regression(I.lag_snapshots(spark, sf))


@query(
    "Q16_scale_advice",
    sql(
        ", t AS (SELECT ts, topic, CAST(sum(log_end_offset - current_offset) AS BIGINT) AS total_lag FROM snaps GROUP BY 1, 2),"
        " c AS (SELECT *, total_lag - lag(total_lag) OVER (ORDER BY ts) AS change FROM t),"
        " s AS (SELECT *, CASE WHEN total_lag < 10000 THEN 0 WHEN total_lag <= 50000 THEN 1 WHEN coalesce(change > 0, false) THEN 3 ELSE 2 END AS step FROM c)"
        " SELECT ts, topic, total_lag, CASE WHEN change > 0 THEN 'growing' WHEN change < 0 THEN 'falling' ELSE 'flat' END AS direction, step::BIGINT AS step,"
        " greatest(least(4 + step, 32), 2)::BIGINT AS target_parallelism, total_lag > 100000 AS page FROM s"
    ),
)
def scale_advice(spark, sf):
    return G.scale_advice(G.consumer_lag(I.lag_snapshots(spark, sf)))


@query(
    "Q17_volume_spike",
    sql(
        "SELECT region, window_start, total_orders, round(mean, 6) AS trailing_mean, CASE WHEN total_orders >= mean * 5 THEN 'spike' WHEN total_orders <= mean * 0.2 THEN 'drop' ELSE 'normal' END AS volume_state FROM ("
        " SELECT region, window_start, total_orders, avg(total_orders) OVER (PARTITION BY region ORDER BY window_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS mean FROM ("
        "  SELECT region, time_bucket(INTERVAL 1 HOUR, event_time) AS window_start, count(*) AS total_orders FROM valid GROUP BY 1, 2))"
    ),
)
def volume_spike(spark, sf):
    return Q.volume_spike(W.window_accumulate(I.valid_orders(spark, sf), ["region"], "1 hour"))


@query("Q18_silent_minutes", _missing("events", "ts", "1 MINUTE", "minute"))
def silent_minutes(spark, sf):
    return Q.silent_minutes(I.events(spark, sf), "ts")


_PROFILED = ["order_id", "customer_id", "currency", "status", "region", "items_count", "amount", "processing_duration_ms"]


@query(
    "Q19_profile_columns",
    sql(
        " UNION ALL ".join(
            (f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count,"
             f" CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, count(DISTINCT {c}) <= 1 AS is_constant FROM valid")
            for c in _PROFILED
        )
    ),
)
def profile_columns(spark, sf):
    return Q.profile_columns(I.staged(I.valid_orders(spark, sf).select(*_PROFILED), "profiled"), _PROFILED)


def _profile_sketches(spark, sf):
    """Sketches per column and hour, written once; the orders are not read again."""
    orders = I.valid_orders(spark, sf).select("event_time", *_PROFILED)
    return I.staged(T.distinct_rollup(I.staged(orders, "profiled"), "event_time", _PROFILED), "profile-sketches")


_NEAR = "count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) <= 1 AS is_constant"


@query(
    "Q19_profile_by_day",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, date_trunc('day', event_time) AS start, {_NEAR.format(c=c)} FROM valid WHERE event_time >= TIMESTAMP '2024-01-08'"
            " AND event_time < TIMESTAMP '2024-01-22' GROUP BY 2"
            for c in _PROFILED
        )
    ),
)
def profile_by_day(spark, sf):
    """Days of two weeks, united from the sketches of their hours."""
    hours = _profile_sketches(spark, sf).filter("start >= '2024-01-08' and start < '2024-01-22'")
    return T.profiles(T.united(hours, "day")).drop("distinct_estimate")


@query(
    "Q6_distinct_sketches",
    sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {_NEAR.format(c=c)}, count(DISTINCT {c}) AS distinct_count, true AS distinct_near FROM valid" for c in _PROFILED)),
)
def distinct_sketches(spark, sf):
    """Hours united to days and days to the whole time: whether each estimate is as near to the exact count as stated."""
    days = T.united(_profile_sketches(spark, sf), "day")
    orders = I.staged(I.valid_orders(spark, sf).select(*_PROFILED), "counted")
    return T.distincts_checked(T.profiles(T.united(days)), orders, _PROFILED)


# --- alarms -----------------------------------------------------------------------------------


# The alarms, written down a second time to check the operator's table.
_SPECS = """
('dlq-spike-critical','DLQRecordCount','Sum','>',100,60,1,1,'notBreaching','CRITICAL'),
('checkpoint-failure-critical','checkpoint_failures_total','Sum','>',0,300,1,1,'notBreaching','CRITICAL'),
('kafka-broker-down-critical','kafka_broker_alive_count','Minimum','<',3,60,1,1,'notBreaching','CRITICAL'),
('firehose-delivery-failure-critical','firehose_failed_put_count','Sum','>',0,60,1,1,'notBreaching','CRITICAL'),
('kafka-consumer-lag-high','consumer_lag_records','Maximum','>',50000,60,2,1,'notBreaching','HIGH'),
('processing-latency-slo-breach','LatencyP99','Average','>',5000,60,2,1,'notBreaching','HIGH'),
('window-completeness-low','WindowCompleteness','Average','<',95,300,1,1,'notBreaching','HIGH'),
('memory-usage-high','memory_usage_percentage','Average','>',85,60,2,1,'notBreaching','MEDIUM'),
('checkpoint-duration-high','checkpoint_duration_ms','Average','>',30000,60,2,1,'notBreaching','MEDIUM'),
('duplicate-detection-spike','DuplicateRecordDetected','Sum','>',10,60,1,1,'notBreaching','MEDIUM'),
('deserialization-error-low','kafka_deserialization_errors_total','Sum','>',5,60,1,1,'notBreaching','LOW')"""
POLICIES = """
('a','DLQRecordCount','Sum','>',100,3600,1,1,'breaching','LOW'),
('b','LatencyP99','Average','>',5000,3600,2,2,'missing','LOW'),
('c','consumer_lag_records','Maximum','>',50000,3600,2,1,'notBreaching','LOW'),
('d','WindowCompleteness','Average','<',95,1800,2,2,'breaching','LOW')"""


POLICY_SPECS = [
    ("a", "DLQRecordCount", "Sum", ">", 100.0, 3600, 1, 1, "breaching", "LOW"),
    ("b", "LatencyP99", "Average", ">", 5000.0, 3600, 2, 2, "missing", "LOW"),
    ("c", "consumer_lag_records", "Maximum", ">", 50000.0, 3600, 2, 1, "notBreaching", "LOW"),
    ("d", "WindowCompleteness", "Average", "<", 95.0, 1800, 2, 2, "breaching", "LOW"),
]


def alarm_states(specs, until="hi"):
    """``until``: the last period of an alarm, by default that of its metric's last datapoint."""
    return f"""
, specs AS (
  SELECT * FROM (VALUES {specs}) v(alarm_name, metric_name, statistic, comparison, threshold, period, n, m, missing, severity)
), reduced AS (
  SELECT alarm_name, epoch_us(ts) // 1000000 // period * period AS sec, round(CASE any_value(statistic) WHEN 'Average' THEN avg(value)
    WHEN 'Sum' THEN sum(value) WHEN 'Maximum' THEN max(value) ELSE min(value) END, 6) AS value
  FROM metrics JOIN specs USING (metric_name) GROUP BY 1, 2
), calendar AS (
  SELECT alarm_name, unnest(generate_series(lo, {until}, period)) AS sec FROM
    (SELECT alarm_name, min(sec) AS lo, max(sec) AS hi FROM reduced GROUP BY 1) JOIN specs USING (alarm_name)
), points AS (
  SELECT c.alarm_name, c.sec, r.value, s.threshold, s.severity, s.n, s.m,
    CASE WHEN r.value IS NOT NULL THEN CASE WHEN s.comparison = '>' THEN r.value > s.threshold ELSE r.value < s.threshold END::INT
      WHEN s.missing = 'breaching' THEN 1 WHEN s.missing = 'notBreaching' THEN 0 ELSE -1 END AS point,
    lag(point, 1, -1) OVER (PARTITION BY c.alarm_name ORDER BY c.sec) AS before
  FROM calendar c JOIN specs s USING (alarm_name) LEFT JOIN reduced r ON r.alarm_name = c.alarm_name AND r.sec = c.sec
), states AS (
  SELECT alarm_name, severity, make_timestamp(sec * 1000000) AS period_start, value, CAST(threshold AS DOUBLE) AS threshold,
    CASE WHEN (point = 1)::INT + (n = 2 AND before = 1)::INT >= m THEN 'ALARM'
      WHEN point = -1 AND (n = 1 OR before = -1) THEN 'INSUFFICIENT_DATA' ELSE 'OK' END AS state
  FROM points
)
"""


_STATES = alarm_states(_SPECS)


@query("L1_evaluate_alarms", sql(_STATES + "SELECT * FROM states"))
def evaluate_alarms(spark, sf):
    """The state of every alarm in every period."""
    return A.evaluate_alarms(I.metrics(spark, sf))


@query("L1_missing_data", sql(alarm_states(POLICIES) + "SELECT * FROM states"))
def missing_data(spark, sf):
    """Alarms that treat missing data as breaching, as missing and as not breaching."""
    return A.evaluate_alarms(I.metrics(spark, sf), POLICY_SPECS)


@query(
    "L2_alarm_specs",
    sql(_STATES + "SELECT alarm_name, metric_name, statistic, comparison, CAST(threshold AS DOUBLE) AS threshold, period::BIGINT AS period_seconds, n::BIGINT AS evaluation_periods,"
        " m::BIGINT AS datapoints_to_alarm, missing AS treat_missing_data, severity, datapoints FROM specs JOIN (SELECT metric_name, count(*) AS datapoints FROM metrics GROUP BY 1) USING (metric_name)"),
)
def alarm_specs(spark, sf):
    """The alarm table with the number of datapoints each alarm can see."""
    counts = I.metrics(spark, sf).groupBy("metric_name").agg(F.count("*").alias("datapoints"))
    return A.alarm_specs(spark).join(counts, "metric_name")


@query(
    "L3_alarm_transitions",
    sql(
        _STATES + ", edges AS (SELECT *, lag(state, 1, 'OK') OVER (PARTITION BY alarm_name ORDER BY period_start) AS before FROM states)"
        " SELECT alarm_name, period_start, before AS from_state, state AS to_state,"
        " coalesce((epoch_us(lead(period_start) OVER (PARTITION BY alarm_name ORDER BY period_start)) - epoch_us(period_start)) // 1000000, -1) AS duration_s FROM edges WHERE before <> state"
    ),
)
def alarm_transitions(spark, sf):
    edges = A.alarm_transitions(A.evaluate_alarms(I.metrics(spark, sf)))
    return edges.withColumn("duration_s", F.coalesce("duration_s", F.lit(-1)))


@query(
    "L4_suggest_threshold",
    sql(_STATES + "SELECT alarm_name, threshold, count(*) AS normal_periods, round(quantile_cont(value, 0.95), 4) AS suggested_threshold FROM states WHERE state = 'OK' AND value IS NOT NULL GROUP BY 1, 2"),
)
def suggest_threshold(spark, sf):
    return A.suggest_threshold(A.evaluate_alarms(I.metrics(spark, sf)))


