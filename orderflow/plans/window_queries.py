"""Event-time windows, late data and features over the given tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.operators import features as X
from orderflow.operators import late as L
from orderflow.operators import windows as W
from orderflow.operators.latency import P50_95_99
from orderflow.plans import inputs as I
from orderflow.plans.oracle import average, percentile, sql
from orderflow.plans.registry import ORACLES, query
from orderflow.session import scratch_path
from orderflow.sources import laid_out as Z
from orderflow.sources import lake as K
from orderflow.sources import orders as R
from orderflow.sources.snapshots import SnapshotLake, hours_of

_METRICS = (
    f"total_orders, CAST(total_amount AS DOUBLE) AS total_amount, {average('total_amount', 'total_orders')} AS avg_order_value,"
    " CAST(max_order_value AS DOUBLE) AS max_order_value"
)
_END_5 = "window_start + INTERVAL 5 MINUTE AS window_end"


# --- event time and windows -------------------------------------------------------------------


@query("T1_with_event_time", sql("SELECT arrival_seq, event_time FROM checked WHERE schema_error IS NULL"))
def with_event_time(spark, sf):
    parsed = I.validated(spark, sf).filter(F.col("schema_error").isNull()).drop("event_time")
    return W.with_event_time(parsed).select("arrival_seq", "event_time")


@query(
    "T3_tumbling",
    sql(
        "SELECT order_id, arrival_seq, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start,"
        " time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE AS window_end FROM valid"
    ),
)
def tumbling(spark, sf):
    return W.tumbling(I.valid_orders(spark, sf)).select(
        "order_id", "arrival_seq", "window_start", "window_end"
    )


@query(
    "T4_window_accumulate",
    sql(
        f"SELECT region, window_start, {_END_5}, total_orders, CAST(total_amount AS DOUBLE) AS total_amount,"
        " CAST(max_order_value AS DOUBLE) AS max_order_value FROM region_windows"
    ),
)
def window_accumulate(spark, sf):
    """Accumulated per arrival day, then merged, as partials of separate batches would be."""
    per_day = W.window_accumulate(
        I.processed_orders(spark, sf, columns=["event_time", "region", "amount"]).withColumn("day", F.to_date("arrival_ts")), ["region", "day"]
    )
    return W.merge_accumulators(per_day, ["region"])


@query(
    "T5_region_window_metrics",
    sql(
        f"SELECT region, window_start, {_END_5}, {_METRICS},"
        " epoch_ms(window_start + INTERVAL 15 MINUTE) AS processing_timestamp_ms FROM region_windows"
    ),
)
def region_window_metrics(spark, sf):
    """The flagship: raw texts → valid → enriched → first arrivals → region windows."""
    closes = F.timestamp_seconds(F.unix_seconds("window_end") + 600)
    return W.region_window_metrics(I.processed_orders(spark, sf, columns=["event_time", "region", "amount"]), emitted_at=closes)


@query("T6_drop_late", sql("SELECT order_id, arrival_seq, event_time FROM late WHERE NOT is_late"))
def drop_late(spark, sf):
    slim = I.processed_orders(spark, sf, columns=["event_time"])
    return L.drop_late(slim).select("order_id", "arrival_seq", "event_time")


@query("T6_late_count", sql("SELECT count(*) AS rows_in, count(*) FILTER (is_late) AS rows_late FROM late"))
def late_count(spark, sf):
    return L.late_count(I.processed_orders(spark, sf, columns=["event_time"]))


@query(
    "T7_route_late",
    sql(f"SELECT order_id, arrival_seq, {_END_5}, CASE WHEN is_late THEN 'late' ELSE 'on_time' END AS side FROM late"),
)
def route_late(spark, sf):
    slim = I.processed_orders(spark, sf, columns=["event_time"])
    on_time, late = L.route_late(slim)
    columns = ["order_id", "arrival_seq", "window_end"]
    return on_time.select(*columns, F.lit("on_time").alias("side")).unionByName(
        late.select(*columns, F.lit("late").alias("side"))
    )


VERSIONS = """
, staged AS (
  SELECT region, window_start, amount, CASE WHEN is_late THEN date_trunc('minute', arrival_ts) END AS stage FROM (
    SELECT *, max(epoch_us(event_time)) OVER (ORDER BY arrival_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM late)
  WHERE NOT coalesce(epoch_us(window_start) + 2700000000 <= seen, false)
), parts AS (
  SELECT region, window_start, stage, count(*) AS n, sum(amount) AS s, max(amount) AS m FROM staged GROUP BY 1, 2, 3
), versions AS (
  SELECT region, window_start, stage IS NOT NULL AS is_correction,
    row_number() OVER w AS version, CAST(sum(n) OVER w AS BIGINT) AS total_orders, sum(s) OVER w AS total_amount, max(m) OVER w AS max_order_value
  FROM parts WINDOW w AS (PARTITION BY region, window_start ORDER BY stage NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
"""


@query(
    "T8_windows_with_corrections",
    sql(VERSIONS + f"SELECT region, window_start, version, is_correction, {_METRICS} FROM versions"),
)
def windows_with_corrections(spark, sf):
    return L.windows_with_corrections(I.processed_orders(spark, sf, columns=["event_time", "region", "amount"])).drop(
        "window_end", "processing_timestamp_ms"
    )


@query(
    "T8_latest_versions",
    sql(
        VERSIONS + f"SELECT region, window_start, version, {_METRICS} FROM versions"
        " QUALIFY row_number() OVER (PARTITION BY region, window_start ORDER BY version DESC) = 1"
    ),
)
def latest_versions(spark, sf):
    versions = L.windows_with_corrections(I.processed_orders(spark, sf, columns=["event_time", "region", "amount"]))
    return L.latest_versions(versions).drop("window_end", "processing_timestamp_ms", "is_correction")


@query(
    "T9_sliding",
    sql(
        "SELECT region, window_start, window_start + INTERVAL 1 HOUR AS window_end, " + _METRICS + " FROM ("
        " SELECT region, time_bucket(INTERVAL 15 MINUTE, event_time) - to_minutes(15 * k) AS window_start,"
        " count(*) AS total_orders, sum(amount) AS total_amount, max(amount) AS max_order_value"
        " FROM valid, (VALUES (0),(1),(2),(3)) s(k) GROUP BY 1, 2)"
    ),
)
def sliding(spark, sf):
    return W.sliding(I.valid_orders(spark, sf), ["region"], "1 hour", "15 minutes").drop(
        "processing_timestamp_ms"
    )


@query(
    "T10_sessions",
    sql(
        "SELECT customer_id, min(event_time) AS session_start, max(event_time) + INTERVAL 6 HOUR AS session_end,"
        " count(*) AS total_orders, CAST(sum(amount) AS DOUBLE) AS total_amount, CAST(max(amount) AS DOUBLE) AS max_order_value FROM ("
        " SELECT *, sum(opens) OVER (PARTITION BY customer_id ORDER BY event_time) AS session FROM ("
        "  SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY customer_id ORDER BY event_time) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens"
        "  FROM valid)) GROUP BY customer_id, session"
    ),
)
def sessions(spark, sf):
    return W.sessions(I.valid_orders(spark, sf), "customer_id", 6 * 3600)


@query(
    "T11_tick_window_stats",
    sql(
        "SELECT ticker, time_bucket(INTERVAL 1 MINUTE, datetime) AS window_start, time_bucket(INTERVAL 1 MINUTE, datetime) + INTERVAL 1 MINUTE AS window_end,"
        " count(*) AS count, round(avg(price), 6) AS avg_price, min(price) AS min_price, max(price) AS max_price, CAST(sum(volume) AS BIGINT) AS total_volume"
        " FROM ticks GROUP BY 1, 2"
    ),
)
def tick_window_stats(spark, sf):
    return W.tick_window_stats(I.ticks(spark, sf))


@query(
    "T12_window_cogroup",
    sql(
        "SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, coalesce(a.w, b.w) AS window_start, orders, errors, max_latency FROM"
        " (SELECT customer_id, time_bucket(INTERVAL 1 HOUR, event_time) AS w, count(*) AS orders FROM valid GROUP BY 1, 2) a FULL JOIN"
        " (SELECT customer_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS w, count(*) FILTER (level = 'ERROR') AS errors, max(latency_ms) AS max_latency FROM logs GROUP BY 1, 2) b"
        " ON a.customer_id = b.customer_id AND a.w = b.w"
    ),
)
def window_cogroup(spark, sf):
    """Orders and log events of a customer met per hour."""
    return W.window_cogroup(
        I.valid_orders(spark, sf), I.log_events(spark, sf), "customer_id", "1 hour",
        {"orders": F.count("*")},
        {"errors": F.count_if(F.col("level") == "ERROR"), "max_latency": F.max("latency_ms")},
        right_ts="timestamp",
    )


_DELAY = "(epoch_us(window_start) // 1000000 // 300 * 37 + length(region) + total_orders * 100) % 2500"


@query(
    "T13_window_emit_latency",
    sql(
        f"SELECT n, p50, p95, p99, p99 > 2000 AS breach FROM (SELECT count(*) AS n, {percentile('d', .5)} AS p50, {percentile('d', .95)} AS p95,"
        f" {percentile('d', .99)} AS p99 FROM (SELECT {_DELAY} AS d FROM region_windows))"
    ),
)
def window_emit_latency(spark, sf):
    """Each window is emitted a derived number of milliseconds after its end."""
    agg = W.region_window_metrics(I.processed_orders(spark, sf, columns=["event_time", "region", "amount"]))
    start = F.unix_seconds("window_start")
    delay = ((start / 300).cast("bigint") * 37 + F.length("region") + F.col("total_orders") * 100) % 2500
    emitted = agg.withColumn("processing_timestamp_ms", F.unix_millis("window_end") + delay)
    return _rounded(W.window_emit_latency(emitted, P50_95_99), "p50", "p95", "p99")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "T14_watermark_lag",
    sql(
        "SELECT minute, make_timestamp(seen - 600000000) AS watermark, lag_ms AS watermark_lag_ms,"
        " CASE WHEN lag_ms > 300000 THEN 'stuck' WHEN lag_ms > 60000 THEN 'lagging' ELSE 'ok' END AS state FROM ("
        " SELECT minute, seen, epoch_us(minute) // 1000 + 60000 - seen // 1000 AS lag_ms FROM ("
        "  SELECT minute, max(m) OVER (ORDER BY minute) AS seen FROM ("
        "   SELECT date_trunc('minute', arrival_ts) AS minute, max(epoch_us(event_time)) AS m FROM valid GROUP BY 1)))"
    ),
)
def watermark_lag(spark, sf):
    return L.watermark_lag(I.valid_orders(spark, sf))


@query(
    "T15_replay_from",
    sql(
        "SELECT region, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, count(*) AS total_orders FROM valid"
        " WHERE arrival_ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY 1, 2"
    ),
)
def replay_from(spark, sf):
    """The second half of the arrivals, processed again by the same operators."""
    ts = F.unix_micros("ts")
    ev = I.table(spark, sf, "events")
    middle = ev.agg(
        F.timestamp_micros(F.min(ts) + F.floor((F.max(ts) - F.min(ts)) / 2))
    ).scalar()
    valid = I.valid_orders(spark, sf)
    again = R.replay_from(valid, "arrival_ts", middle)
    return W.window_accumulate(again, ["region"]).select("region", "window_start", "total_orders")


# --- features ---------------------------------------------------------------------------------


def _tick_features(spark, sf):
    return I.ticks(spark, sf).select(
        "ticker", "price", "volume", F.col("datetime").alias("event_time"), "event_id"
    )


@query(
    "F3_online_latest",
    sql("SELECT ticker, price, volume, datetime AS event_time, event_id FROM ticks QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY datetime DESC, event_id DESC) = 1"),
)
def online_latest(spark, sf):
    return X.online_latest(_tick_features(spark, sf), "ticker", "event_time", "event_id")


@query(
    "F4_get_records",
    sql(
        "SELECT c_custkey, last_order, f.k IS NOT NULL AS found FROM customer LEFT JOIN"
        " (SELECT user_id AS k, max(event_id) AS last_order FROM events GROUP BY 1) f ON f.k = c_custkey"
    ),
)
def get_records(spark, sf):
    """Every customer looked up among the users with events."""
    online = X.online_latest(
        I.table(spark, sf, "events").select(
            F.col("user_id").alias("c_custkey"), F.col("event_id").alias("last_order")
        ),
        "c_custkey", "last_order",
    )
    return X.get_records(online, I.table(spark, sf, "customer"), "c_custkey")


@query(
    "F5_point_in_time",
    sql(
        "SELECT l.arrival_seq, l.customer_id, l.event_time, f.timestamp AS feature_time, f.latency_ms, f.operator FROM valid l ASOF LEFT JOIN"
        " (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY customer_id, timestamp ORDER BY order_id DESC) = 1) f"
        " ON f.customer_id = l.customer_id AND f.timestamp <= l.event_time"
    ),
)
def point_in_time(spark, sf):
    """Each order with its customer's latest log event at or before it."""
    labels = I.valid_orders(spark, sf).select("customer_id", "arrival_seq", "event_time")
    return X.point_in_time(
        I.staged(labels, "labels"), I.log_table(spark, sf), "customer_id", "event_time", "timestamp",
        ["latency_ms", "operator"], tie="order_id",
    )


@query("F5_laid_out_history", ORACLES["F5_point_in_time"])
def laid_out_history(spark, sf):
    """The same from a history that is laid out by customer and day in blocks of 32 log events and read in place."""
    labels = I.staged(I.valid_orders(spark, sf).select("customer_id", "arrival_seq", "event_time"), "labels")
    history = Z.lay_out(
        I.log_table(spark, sf), scratch_path(spark, "laid-out"), "customer_id", "timestamp", ["latency_ms", "operator"], "order_id", 8,
        block_rows=32, slice_seconds=86400,
    )
    return Z.lookup_as_of(labels, history, "customer_id", "event_time")


def _span(seconds: int) -> str:
    return f"(PARTITION BY customer_id ORDER BY us RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND 1 PRECEDING)"


SPANS = {"1h": 3600, "1d": 86400, "7d": 7 * 86400}


@query(
    "F6_customer_history",
    sql(
        "SELECT arrival_seq, customer_id, "
        + ", ".join(
            f"count(*) OVER {_span(s)} AS orders_{n}, CAST(coalesce(sum(amount) OVER {_span(s)}, 0) AS DOUBLE) AS amount_{n}"
            for n, s in SPANS.items()
        )
        + ", (us - max(us) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) // 1000000 AS recency_s"
        " FROM (SELECT *, epoch_us(event_time) AS us FROM valid)"
    ),
)
def customer_history(spark, sf):
    orders = I.valid_orders(spark, sf).select("customer_id", "arrival_seq", "event_time", "amount")
    return X.customer_history(I.staged(orders, "history"), "customer_id", "event_time", "amount", SPANS).drop(
        "event_time", "amount"
    )


@query(
    "F7_feature_quality",
    sql(
        "SELECT count(*) AS records, count(DISTINCT ticker) AS keys, max(datetime) AS newest,"
        " CAST(epoch(TIMESTAMP '2024-02-01') - max(epoch(datetime)) AS BIGINT) AS age_s,"
        " count(*) FILTER (event_id % 5 = 0) AS null_price, 0::BIGINT AS null_ticker, 0::BIGINT AS null_event_time,"
        " count(*) FILTER (event_id % 7 = 0 AND event_id % 5 <> 0) AS bad_price FROM ticks"
    ),
)
def feature_quality(spark, sf):
    e = F.col("event_id")
    price = F.when(e % 5 == 0, None).when(e % 7 == 0, "n/a").otherwise(F.col("price").cast("string"))
    t = _tick_features(spark, sf).select("ticker", price.alias("price"), "event_time")
    return X.feature_quality(
        t, "ticker", "event_time", ["price"], F.lit("2024-02-01 00:00:00").cast("timestamp")
    )


@query(
    "F8_expire_features",
    sql("SELECT event_id, ticker FROM ticks WHERE datetime >= (SELECT max(datetime) FROM ticks) - INTERVAL 7 DAY"),
)
def expire_features(spark, sf):
    t = _tick_features(spark, sf)
    return X.expire_features(t, "event_time", 7 * 86400, I.newest(t, "event_time")).select(
        "event_id", "ticker"
    )


@query(
    "F9_online_offline_parity",
    sql(
        "SELECT coalesce(a.user_id, c_custkey) AS custkey, CASE WHEN c_custkey IS NULL THEN 'missing_online' WHEN a.user_id IS NULL THEN 'missing_offline'"
        " WHEN p <> c_nationkey THEN 'different' ELSE 'equal' END AS parity FROM"
        " (SELECT user_id, CAST(max_by(event_id % 25, event_id) AS INT) AS p FROM events GROUP BY 1) a FULL JOIN"
        " (SELECT c_custkey, c_nationkey FROM customer) ON user_id = c_custkey"
    ),
)
def online_offline_parity(spark, sf):
    """A derived attribute of users' newest events against the customer table."""
    history = I.table(spark, sf, "events").select(
        F.col("user_id").alias("custkey"), "event_id",
        (F.col("event_id") % 25).cast("int").alias("nation"),
    )
    newest = X.online_latest(history, "custkey", "event_id")
    offline = newest.select("custkey", "nation", F.lit(1).alias("version"))
    online = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"),
        F.lit(1).alias("version"),
    )
    return X.online_offline_parity(offline, online, "custkey", "version")


@query(
    "F10_last_minute_volume",
    sql(
        "SELECT ticker, window_end, total_volume, epoch(now_ts) - epoch(window_end) <= 60 AS is_last_minute FROM ("
        " SELECT ticker, time_bucket(INTERVAL 1 MINUTE, datetime) + INTERVAL 1 MINUTE AS window_end, CAST(sum(volume) AS BIGINT) AS total_volume, any_value(now_ts) AS now_ts"
        " FROM ticks, (SELECT max(datetime) AS now_ts FROM ticks) GROUP BY 1, 2)"
        " WHERE window_end <= now_ts QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY window_end DESC) = 1"
    ),
)
def last_minute_volume(spark, sf):
    t = I.ticks(spark, sf)
    return X.last_minute_volume(W.tick_window_stats(t), "ticker", I.newest(t, "datetime"))


# --- lake -------------------------------------------------------------------------------------


def _lake(spark, sf, rows_per_file=2_000_000):
    path = I.scratch_path(spark, "lake")
    K.write_lake(I.events(spark, sf), path, "ts", rows_per_file=rows_per_file)
    return path


def _flush_rows(events, least):
    """Rows per file of a lake of small files: those of one flush in the busiest hour, ``least`` at least. So an hour has a file for each of its
    flushes, and the number of files follows the hours and not the rows."""
    busiest = hours_of(events, "ts").agg(F.max("rows")).first()[0] or 0
    return max(least, -(-busiest // K.FLUSHES_AN_HOUR))


@query(
    "S6_read_lake",
    "SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:30:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'",
)
def read_lake(spark, sf):
    """All events written hour-partitioned, then a pruned read of a time range."""
    path = _lake(spark, sf)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, v decimal(18,2)"
    return K.read_lake(
        spark, path, datetime(2024, 1, 10, 6, 30), datetime(2024, 1, 12, 18), "ts", schema
    ).select("event_id", "ts", "event_type")


@query(
    "K8_lake_age_tiers",
    "SELECT strftime(d, '%Y') AS year, strftime(d, '%m') AS month, strftime(d, '%d') AS day, strftime(d, '%H') AS hour, age_days,"
    " CASE WHEN age_days >= 365 THEN 'deep_archive' WHEN age_days >= 90 THEN 'glacier' ELSE 'standard' END AS tier, age_days >= 2555 AS delete_due FROM ("
    " SELECT DISTINCT date_trunc('hour', ts) AS d, date_diff('day', ts::DATE, DATE '2024-04-15') AS age_days FROM events)",
)
def lake_age_tiers(spark, sf):
    parts = K.partitions_of_files(K.lake_files(spark, _lake(spark, sf)))
    today = F.lit("2024-04-15").cast("date")
    return K.lake_age_tiers(parts, today, 2555).drop("files", "bytes")


_HOURS = (
    "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour,"
    " 1::BIGINT AS files, count(*) AS rows FROM events GROUP BY ALL"
)


@query("K5_write_lake", _HOURS)
def write_lake(spark, sf):
    """Files and rows of every hour; an hour below the size of a file has one."""
    path = _lake(spark, sf)
    files = K.partitions_of_files(K.lake_files(spark, path)).drop("bytes")
    return files.join(K.rows_per_hour(K.lake_table(spark, path)), K.PARTITIONS)


@query("K9_compact_partitions", _HOURS)
def compact_partitions(spark, sf):
    """An hour of several small files becomes one file with all its rows."""
    into = I.scratch_path(spark, "compact")
    small = _flush_rows(I.events(spark, sf), 8)
    files = K.compact_partitions(spark, _lake(spark, sf, rows_per_file=small), into).drop("bytes")
    return files.join(K.rows_per_hour(K.lake_table(spark, into)), K.PARTITIONS)


@query(
    "K9_snapshots",
    "SELECT moment, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events,"
    " (VALUES ('before', 2), ('during', 3), ('after', 3), ('after, of the version before', 2)) m(moment, parts) WHERE event_id % 3 < parts GROUP BY 1, 2",
)
def snapshots(spark, sf):
    """Rows per day before compaction, while it has written but not committed and another flush arrives, and after it; the old version stays as it was."""
    lake = SnapshotLake(spark, I.scratch_path(spark, "snapshots"), "ts")
    events = I.staged(I.events(spark, sf), "events")
    for part in (0, 1):
        rows = events.filter(F.col("event_id") % 3 == part)
        lake.append(rows, rows_per_file=_flush_rows(rows, 8))
    old, seen = lake.commit_of()["version"], {}
    seen["before"] = lake.read()

    def meanwhile():
        lake.append(events.filter(F.col("event_id") % 3 == 2))
        seen["during"] = lake.read()

    lake.compact(while_running=meanwhile)
    seen |= {"after": lake.read(), "after, of the version before": lake.read(version=old)}
    days = []
    for moment, rows in seen.items():
        day = F.date_format("ts", "yyyy-MM-dd").alias("day")
        counts = F.count("*").alias("rows"), F.countDistinct(F.date_trunc("hour", "ts")).alias("hours")
        days.append(rows.groupBy(day).agg(*counts).withColumn("moment", F.lit(moment)))
    return reduce(DataFrame.unionByName, days)


@query(
    "K9_snapshot_files",
    "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour, 1::BIGINT AS files FROM events GROUP BY ALL",
)
def snapshot_files(spark, sf):
    """After compaction an hour of many small files has one file."""
    lake = SnapshotLake(spark, I.scratch_path(spark, "snapshots"), "ts")
    events = I.events(spark, sf)
    lake.append(events, rows_per_file=_flush_rows(events, 4))
    lake.compact()
    return lake.files().groupBy(*K.PARTITIONS).agg(F.count("*").alias("files"))
