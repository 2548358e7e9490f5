"""Streaming operators, replayed over the given tables until all input is consumed.

A replay writes the derived records into a folder in arrival order, one chunk after another, and
runs the query over what is there after each: every chunk is one micro-batch, and every run after
the first resumes from the checkpoint. Results are therefore reproducible and most have SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderflow.operators import enrich as E
from orderflow.operators import features as X
from orderflow.operators import rollups as R
from orderflow.operators import validate as V
from orderflow.operators import windows as W
from orderflow.plans import inputs as I
from orderflow.plans.health_queries import POLICIES, POLICY_SPECS, alarm_states
from orderflow.plans.oracle import average, sql
from orderflow.plans.registry import ORACLES, query
from orderflow.plans.window_queries import SPANS, VERSIONS
from orderflow.session import scratch_path
from orderflow.sources.indexed import indexed_log, replay_indexed
from orderflow.sources.orders import parse_ticks, read_orders_stream
from orderflow.streaming import alarms as L
from orderflow.streaming import histories as H
from orderflow.streaming import jobs as J
from orderflow.streaming import panes as P
from orderflow.streaming import records as U
from orderflow.streaming import sinks as K
from orderflow.streaming.dedup import dedup_within_watermark

def chunks(df: DataFrame, order: str, n: int) -> list[DataFrame]:
    """The rows in ``n`` consecutive ranges of ``order``."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // n
    bounds = [low + step * i for i in range(1, n)]
    edges = [None, *bounds, None]
    parts = []
    for start, end in zip(edges, edges[1:]):
        part = df if start is None else df.filter(F.col(order) >= start)
        parts.append(part if end is None else part.filter(F.col(order) < end))
    return parts


def replay(
    records: DataFrame, start: Callable[[DataFrame, str], StreamingQuery], n: int = 1,
    order: str = "arrival_seq",
) -> tuple[StreamingQuery, str]:
    """Replay ``records`` in ``n`` chunks. ``start(stream, checkpoint)`` starts one bounded run.
    Returns the last run and the checkpoint folder."""
    spark = records.sparkSession
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    staged = I.staged(records, "records") if n > 1 else records
    parts = chunks(staged, order, n) if n > 1 else [staged]
    last = None
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = read_orders_stream(spark, {"files": source, "schema": records.schema})
        last = start(stream, checkpoint)
        last.awaitTermination()
    return last, checkpoint


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return I.valid_orders(spark, sf, deal=True).select(
        "order_id", "customer_id", "arrival_seq", "arrival_ts", "event_time", "region", "amount"
    )


_ALL = f"total_orders, CAST(total_amount AS DOUBLE) AS total_amount, {average('total_amount', 'total_orders')} AS avg_order_value, CAST(max_order_value AS DOUBLE) AS max_order_value"
_GROUP = "count(*) AS total_orders, sum(amount) AS total_amount, max(amount) AS max_order_value"
_FIRST = ", firsts AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY arrival_seq) = 1)"


@query("S1_read_orders_stream", sql("SELECT value, topic, partition, arrival_seq, arrival_ts FROM raw"))
def read_stream(spark, sf):
    raw, out = I.raw_orders(spark, sf), scratch_path(spark, "out")
    replay(raw, lambda s, ck: K.write_table(s, out, ck, None))
    return spark.read.schema(raw.schema).parquet(out)


@query(
    "T2_bounded_lateness",
    sql(
        "SELECT event_minute, n FROM (SELECT date_trunc('minute', event_time) AS event_minute, count(*) AS n FROM valid GROUP BY 1)"
        " WHERE epoch_us(event_minute) + 60000000 <= (SELECT max(epoch_us(event_time)) // 1000 * 1000 - 600000000 FROM valid)"
    ),
)
def bounded_lateness(spark, sf):
    """Minutes that the watermark has passed: all up to ten minutes before the largest event time."""
    out = scratch_path(spark, "out")

    def start(stream, checkpoint):
        minutes = W.with_bounded_lateness(stream).groupBy(F.window("event_time", "1 minute").alias("w"))
        return K.write_table(minutes.agg(F.count("*").alias("n")), out, checkpoint, None)

    replay(_valid(spark, sf), start)
    return spark.read.parquet(out).select(F.col("w.start").alias("event_minute"), "n")


_HALF = ", half AS (SELECT min(arrival_seq) + (max(arrival_seq) - min(arrival_seq)) // 2 AS h FROM valid)"


@query(
    "T6_drop_late_stream",
    sql(
        _HALF + ", mark AS (SELECT max(epoch_us(event_time)) // 1000 * 1000 - 600000000 AS w FROM valid, half WHERE arrival_seq < h),"
        " kept AS (SELECT v.* FROM valid v, half, mark WHERE arrival_seq < h OR epoch_us(time_bucket(INTERVAL 5 MINUTE, event_time)) + 300000000 > w)"
        f" SELECT region, window_start, {_ALL} FROM (SELECT region, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, {_GROUP} FROM kept GROUP BY 1, 2)"
        " WHERE epoch_us(window_start) + 300000000 <= (SELECT max(epoch_us(event_time)) // 1000 * 1000 - 600000000 FROM valid)"
    ),
)
def drop_late_stream(spark, sf):
    """Append-mode windows over two micro-batches: a row is dropped when its window was closed by
    the previous micro-batch's watermark."""
    out = scratch_path(spark, "out")
    replay(_valid(spark, sf), lambda s, ck: K.write_table(J.region_windows(s), out, ck, None), n=2)
    return spark.read.parquet(out).drop("window_end", "processing_timestamp_ms")


@query(
    "T7_route_late_stream",
    sql(
        "SELECT order_id, arrival_seq, CASE WHEN epoch_us(time_bucket(INTERVAL 5 MINUTE, event_time)) + 900000000 <="
        " coalesce(max(epoch_us(event_time)) OVER (ORDER BY arrival_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 'late' ELSE 'on_time' END AS side FROM valid"
    ),
)
def route_late_stream(spark, sf):
    """Late rows to their own table, over three micro-batches that hand on what they have seen."""
    root = _late_run(spark, sf)
    sides = [
        spark.read.parquet(f"{root}/{name}").select("order_id", "arrival_seq", F.lit(name).alias("side"))
        for name in ("on_time", "late")
    ]
    return sides[0].unionByName(sides[1])


def _late_run(spark, sf):
    root = scratch_path(spark, "late")
    replay(
        _valid(spark, sf), lambda s, ck: K.write_each(s, J.route_late_batches(root), ck, None), n=3
    )
    return root


@query(
    "T6_late_count_stream",
    sql(
        "SELECT count(*) AS rows_in, count(*) FILTER (late) AS rows_late FROM (SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, event_time)) + 900000000 <="
        " coalesce(max(epoch_us(event_time)) OVER (ORDER BY arrival_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS late FROM valid)"
    ),
)
def late_count_stream(spark, sf):
    """Rows and late rows of all micro-batches, as the late sink counts them."""
    counts = spark.read.parquet(f"{_late_run(spark, sf)}/counts")
    return counts.agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_late").alias("rows_late"))


@query(
    "T8_corrections_stream",
    sql(f"SELECT region, window_start, {_ALL} FROM (SELECT region, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, {_GROUP} FROM valid GROUP BY 1, 2)"),
)
def corrections_stream(spark, sf):
    """Update-mode windows that late rows correct; the upsert log ends with every row counted."""
    out = scratch_path(spark, "upsert")

    def start(stream, checkpoint):
        windows = J.region_windows(stream, lateness="40 days")
        return K.write_each(windows, K.upsert_by_key(out), checkpoint, None, mode="update")

    replay(_valid(spark, sf), start, n=3)
    schema = (
        "region string, window_start timestamp, total_orders bigint, total_amount decimal(38,6),"
        " avg_order_value decimal(18,2), max_order_value decimal(24,6)"
    )
    return K.read_upserted(spark, out, ["region", "window_start"], schema)


def _paned(spark, sf, n=4):
    root = scratch_path(spark, "panes")
    slim = I.processed_orders(spark, sf, columns=["event_time", "region", "amount"])
    replay(slim.drop("order_id"), lambda s, ck: K.write_each(s, P.pane_batches(root), ck, None), n=n)
    return root


_CLOSED = " epoch_us(window_start) + 900000000 <= (SELECT max(epoch_us(event_time)) FROM processed)"


@query(
    "T8_versions_stream",
    sql(VERSIONS + f"SELECT region, window_start, version, is_correction, {_ALL} FROM versions WHERE" + _CLOSED),
)
def versions_stream(spark, sf):
    """Firings and corrections of windows that open, close and are forgotten during a replay of four micro-batches: the versions of the batch operator,
    of all windows that have closed by the end."""
    return P.read_versions(spark, _paned(spark, sf)).drop("window_end", "processing_timestamp_ms")


@query(
    "T8_too_late_stream",
    sql(
        "SELECT arrival_seq FROM (SELECT *, max(epoch_us(event_time)) OVER (ORDER BY arrival_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen"
        " FROM processed) WHERE epoch_us(time_bucket(INTERVAL 5 MINUTE, event_time)) + 2700000000 <= seen"
    ),
)
def too_late_stream(spark, sf):
    """Rows that came after their window was forgotten."""
    return spark.read.parquet(f"{_paned(spark, sf)}/too_late").select("arrival_seq")


def _outcomes(spark, sf):
    """The first streaming query, raw texts to outcomes, over three micro-batches; arrivals span a month, so the
    24-hour memory expires many times."""
    root = scratch_path(spark, "outcomes")
    write = J.write_outcomes(root, at=I.processed_at())
    replay(I.raw_orders(spark, sf, deal=True), lambda s, ck: K.write_each(s, write, ck, None), n=3)
    return J.read_outcomes(spark, root)


@query("D1_dedup_stream", sql("SELECT order_id, arrival_seq, is_dup FROM flagged"))
def dedup_stream(spark, sf):
    """Which arrival of each order won, and which were duplicates."""
    valid = F.col("error_type").isNull() | (F.col("error_type") == "DUPLICATE")
    return _outcomes(spark, sf).filter(valid).select(
        "order_id", "arrival_seq", F.col("error_type").isNotNull().alias("is_dup")
    )


@query(
    "K1_write_processed",
    sql("SELECT order_id, arrival_seq, customer_id, CAST(amount AS DOUBLE) AS amount, tax, region, merchant_id, event_time FROM processed"),
)
def write_processed(spark, sf):
    """Processed orders of the streaming query; late ones are in, since it has no watermark."""
    return J.processed_of(_outcomes(spark, sf)).select(
        "order_id", "arrival_seq", "customer_id", "amount", "tax", "region", "merchant_id", "event_time"
    )


@query(
    "K2_write_dlq",
    sql(
        "SELECT error_type, attempted_order_id, count(*) AS n FROM ("
        " SELECT error_type, CASE WHEN error_type <> 'SCHEMA_INVALID' THEN order_id END AS attempted_order_id FROM checked WHERE error_type IS NOT NULL UNION ALL"
        " SELECT 'DUPLICATE', order_id FROM flagged WHERE is_dup) GROUP BY ALL"
    ),
)
def write_dlq(spark, sf):
    return (
        J.dlq_of(_outcomes(spark, sf))
        .groupBy("error_type", "attempted_order_id")
        .agg(F.count("*").alias("n"))
    )


@query(
    "K3_write_aggregations",
    sql(
        f"SELECT region, window_start, {_ALL} FROM (SELECT region, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, {_GROUP} FROM valid GROUP BY 1, 2)"
        " WHERE epoch_us(window_start) + 300000000 <= (SELECT max(epoch_us(event_time)) // 1000 * 1000 - 600000000 FROM valid)"
    ),
)
def write_aggregations(spark, sf):
    """Append-mode window metrics: every window the final watermark has closed."""
    out = scratch_path(spark, "aggregations")
    replay(_valid(spark, sf), lambda s, ck: K.write_table(J.region_windows(s), out, ck, None))
    return spark.read.parquet(out).drop("window_end", "processing_timestamp_ms")


@query("K4_archive_messages", sql("SELECT value AS message, topic, partition, arrival_seq AS \"offset\" FROM raw"))
def archive_messages(spark, sf):
    out = scratch_path(spark, "archive")
    envelopes = I.raw_orders(spark, sf).select(
        "value", "topic", "partition", F.col("arrival_seq").alias("offset"),
        F.unix_millis("arrival_ts").alias("timestamp"),
    )
    replay(
        envelopes, lambda s, ck: K.write_each(s, K.archive_messages(out), ck, None), n=2,
        order="offset",
    )
    schema = "message string, topic string, partition int, offset bigint"
    return spark.read.schema(schema).json(out).select("message", "topic", "partition", "offset")


@query("K5_write_lake_stream", "SELECT event_id, ts, event_type FROM events")
def write_lake_stream(spark, sf):
    out = scratch_path(spark, "lake")
    replay(I.events(spark, sf), lambda s, ck: K.write_lake_stream(s, out, ck, "ts", None))
    return spark.read.parquet(out).select("event_id", "ts", "event_type")


@query(
    "K6_upsert_by_key",
    sql("SELECT customer_id, order_id, arrival_seq, region FROM valid QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY arrival_seq DESC) = 1"),
)
def upsert_by_key(spark, sf):
    """Each customer's newest order, upserted over two micro-batches."""
    out = scratch_path(spark, "upsert")
    rows = _valid(spark, sf).select("customer_id", "order_id", "arrival_seq", "region")
    write = K.upsert_by_key(out, ["customer_id"], "arrival_seq")
    replay(rows, lambda s, ck: K.write_each(s, write, ck, None), n=2)
    schema = "customer_id string, order_id string, arrival_seq bigint, region string"
    return K.read_upserted(spark, out, ["customer_id"], schema, order="arrival_seq")


@query(
    "F4_lookup_in_runs",
    "SELECT c_custkey, event_id, event_type, k IS NOT NULL AS found FROM customer LEFT JOIN"
    " (SELECT user_id AS k, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) ON k = c_custkey",
)
def lookup_in_runs(spark, sf):
    """Every customer looked up in the records that six micro-batches upserted, after two merges of runs."""
    out = scratch_path(spark, "records")
    records = I.events(spark, sf).select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    write = U.upsert_records(out, ["c_custkey"], "event_id", fan=2, buckets=16)
    replay(records, lambda s, ck: K.write_each(s, write, ck, None), n=6, order="event_id")
    store = U.UpsertedRecords(spark, out, ["c_custkey"], records.schema, "event_id", fan=2, buckets=16)
    return store.lookup(I.table(spark, sf, "customer"))


@query(
    "K7_fan_out",
    sql("SELECT CASE WHEN error_type IS NULL THEN 'valid' ELSE 'rejected' END AS output, arrival_seq FROM checked"),
)
def fan_out(spark, sf):
    """Two tables off one parsed stream."""
    root = scratch_path(spark, "fanout")
    outputs = {
        "valid": lambda batch: V.route(batch)[0].select("arrival_seq"),
        "rejected": lambda batch: V.route(batch)[1].select("arrival_seq"),
    }
    replay(
        I.raw_orders(spark, sf),
        lambda s, ck: K.write_each(V.validate_orders(s), K.fan_out(outputs, root), ck, None),
        n=2,
    )
    tables = [
        spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("output"), "arrival_seq")
        for name in outputs
    ]
    return tables[0].unionByName(tables[1])


@query(
    "E7_enrich_stream",
    sql(
        "SELECT event_id, c_name AS company_name, CASE WHEN c_name IS NULL THEN 'No reference row for custkey ' || ev.user_id * 11 END AS error_message"
        " FROM ev LEFT JOIN customer ON c_custkey = ev.user_id * 11"
    ),
)
def enrich_stream(spark, sf):
    """A stream of events looked up in the customer table, two micro-batches."""
    out = scratch_path(spark, "enriched")
    events = I.events(spark, sf).select("event_id", (F.col("user_id") * 11).alias("custkey"))
    ref = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("company_name"))
    replay(
        events, lambda s, ck: K.write_table(E.with_reference(s, ref, "custkey", ["company_name"]), out, ck, None),
        n=2, order="event_id",
    )
    return spark.read.parquet(out).select("event_id", "company_name", "error_message")


@query(
    "T12_window_cogroup_stream",
    sql(
        "SELECT * FROM (SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, coalesce(a.w, b.w) AS window_start, orders, errors FROM"
        " (SELECT customer_id, time_bucket(INTERVAL 1 HOUR, event_time) AS w, count(*) AS orders FROM valid GROUP BY 1, 2) a FULL JOIN"
        " (SELECT customer_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS w, count(*) FILTER (level = 'ERROR') AS errors FROM logs GROUP BY 1, 2) b"
        " ON a.customer_id = b.customer_id AND a.w = b.w) WHERE epoch_us(window_start) + 3600000000 <= least((SELECT max(epoch_us(event_time)) FROM valid), (SELECT max(epoch_us(timestamp)) FROM logs)) // 1000 * 1000 - 600000000"
    ),
)
def window_cogroup_stream(spark, sf):
    """Orders and log events of a customer met per hour, as two streams."""
    out, checkpoint = scratch_path(spark, "met"), scratch_path(spark, "checkpoint")
    sides = []
    for name, rows in (("orders", _valid(spark, sf)), ("logs", I.log_events(spark, sf).drop("context"))):
        folder = scratch_path(spark, name)
        rows.write.parquet(folder)
        sides.append(read_orders_stream(spark, {"files": folder, "schema": rows.schema}))
    met = W.window_cogroup_stream(
        *sides, "customer_id", "1 hour", {"orders": F.count("*")}, {"errors": F.count_if(F.col("level") == "ERROR")},
        right_ts="timestamp",
    )
    K.write_table(met, out, checkpoint, None).awaitTermination()
    return spark.read.parquet(out)


@query(
    "D3_dedup_within_watermark",
    sql(
        "SELECT order_id, count(*) AS n FROM ("
        " SELECT order_id FROM valid QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY arrival_ts) = 1 UNION ALL"
        " SELECT v.order_id FROM valid v JOIN (SELECT order_id, min(arrival_ts) AS first FROM valid GROUP BY 1) f USING (order_id), (SELECT min(arrival_seq) AS a, max(arrival_seq) AS b FROM valid)"
        "  WHERE v.arrival_seq >= a + (b - a) // 2 AND f.first + INTERVAL 2 HOUR <= (SELECT to_timestamp(0)::TIMESTAMP + to_microseconds(max(epoch_us(arrival_ts)) // 1000 * 1000 - 7200000000) FROM valid WHERE arrival_seq < a + (b - a) // 2)"
        "  AND f.first < v.arrival_ts GROUP BY 1"
        ") GROUP BY 1"
    ),
)
def dedup_watermark(spark, sf):
    """Two micro-batches and a delay of 2 hours: a copy is dropped while its order is remembered, and taken where the first micro-batch's watermark has
    passed the end of that memory."""
    out = scratch_path(spark, "dedup")

    def start(stream, checkpoint):
        unique = dedup_within_watermark(stream, "order_id", "arrival_ts", "2 hours")
        return K.write_table(unique.select("order_id"), out, checkpoint, None)

    replay(_valid(spark, sf), start, n=2)
    return spark.read.parquet(out).groupBy("order_id").agg(F.count("*").alias("n"))


def _features(spark, sf):
    root = scratch_path(spark, "features")
    nameless = F.regexp_replace("value", '"ticker":"[A-Z]+",', "")
    ticks = I.tick_texts(spark, sf).withColumn(
        "value", F.when(F.col("event_id") % 50 == 7, nameless).otherwise(F.col("value"))
    )

    def start(stream, checkpoint):
        record = X.to_feature_record(
            parse_ticks(stream).withColumn(
                "datetime", F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'")
            ),
            keep=["event_id"],
        ).drop("record")
        return K.write_each(record, K.ingest_features(root, "ticker", "event_time", "event_id"), checkpoint, None)

    replay(ticks, start, n=2, order="event_id")
    return root


@query(
    "O19_rollup_stream",
    sql(
        "SELECT metric_name, start, count(*) AS n, min(value) AS low, max(value) AS high, list_sort(list(value))[greatest(1, ceil(0.95 * count(*)))::INT] AS p95"
        " FROM (SELECT *, date_trunc('hour', ts) AS start FROM metrics WHERE date_trunc('day', ts) > TIMESTAMP '2024-01-09') GROUP BY 1, 2"
    ),
)
def rollup_stream(spark, sf):
    """Sketches that three micro-batches leave behind, merged to hours; the first days are past their retention and not read."""
    out = scratch_path(spark, "rollups")
    points = I.metrics(spark, sf).select("ts", "metric_name", "value", "event_id")
    replay(
        points, lambda s, ck: K.write_each(s, K.rollup_batches(out, ["metric_name"], "ts", "value"), ck, None), n=3, order="event_id"
    )
    hours = K.read_rollups(spark, out, ["metric_name"], "hour", since="2024-01-10")
    return R.with_quantiles(hours, {"p95": 0.95}).drop("sketch", "total")


_PASSED = "((SELECT max(epoch_us(ts)) // 1000 - 600000 FROM metrics) // 1000 // period - 1) * period"
_POLICY_STATES = alarm_states(POLICIES, _PASSED)


def _alarm_run(spark, sf, changes=False):
    out = scratch_path(spark, "alarms")

    def start(stream, checkpoint):
        states = L.evaluate_alarms_stream(stream, POLICY_SPECS)
        return K.write_table(L.changes(states) if changes else states, out, checkpoint, None)

    replay(I.metrics(spark, sf).drop("dims"), start, n=3, order="event_id")
    return spark.read.parquet(out)


@query("L1_alarm_states_stream", sql(_POLICY_STATES + "SELECT * FROM states"))
def alarm_states_stream(spark, sf):
    """The states of L1_missing_data by timers, over three runs that resume from their checkpoint: every period that the watermark has passed, with or without datapoints."""
    return _alarm_run(spark, sf).drop("from_state", "held_s")


@query(
    "L3_alarm_changes_stream",
    sql(
        _POLICY_STATES + ", edges AS (SELECT *, lag(state, 1, 'OK') OVER w AS from_state, min(period_start) OVER w AS begun FROM states"
        " WINDOW w AS (PARTITION BY alarm_name ORDER BY period_start))"
        " SELECT alarm_name, severity, period_start, from_state, state AS to_state, (epoch_us(period_start) - epoch_us(coalesce(lag(period_start)"
        " OVER (PARTITION BY alarm_name ORDER BY period_start), begun))) // 1000000 AS held_s FROM edges WHERE from_state <> state"
    ),
)
def alarm_changes_stream(spark, sf):
    """Each change of a state as it happens, with how long the state before had lasted."""
    return _alarm_run(spark, sf, changes=True)


_STAMP = "strftime(datetime, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "F1_ingest_features",
    sql(
        f"SELECT event_id, md5(name || '_' || {_STAMP}) AS id, name AS ticker, CAST(price AS VARCHAR) AS price, {_STAMP} AS datetime, {_STAMP} AS event_time"
        " FROM (SELECT *, CASE WHEN event_id % 50 = 7 THEN '' ELSE ticker END AS name FROM ticks)"
        " QUALIFY row_number() OVER (PARTITION BY name ORDER BY datetime DESC, event_id DESC) = 1"
    ),
)
def ingest_features(spark, sf):
    """The online side after both stores were fed in one pass; some ticks have no ticker."""
    schema = "event_id bigint, id string, ticker string, price string, datetime string, event_time string"
    return K.read_upserted(
        spark, f"{_features(spark, sf)}/online", ["ticker"], schema, order="event_time"
    )


@query("F2_offline_append", sql("SELECT event_id, CASE WHEN event_id % 50 = 7 THEN '' ELSE ticker END AS ticker, strftime(datetime, '%Y-%m-%d') AS event_date FROM ticks"))
def offline_append(spark, sf):
    history = spark.read.parquet(f"{_features(spark, sf)}/offline")
    return history.select("event_id", "ticker", "event_date")


@query(
    "T15_indexed_replay",
    sql(
        "SELECT arrival_seq, topic, partition, arrival_ts, value FROM raw WHERE arrival_ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"
        " AND arrival_seq < (SELECT min(arrival_seq) + (max(arrival_seq) - min(arrival_seq)) // 10 * 9 FROM raw)"
    ),
)
def indexed_replay(spark, sf):
    """A range of arrival times and offsets out of a log that two micro-batches wrote, by its index of files."""
    out, raw = scratch_path(spark, "log"), I.raw_orders(spark, sf)
    replay(raw, lambda s, ck: K.write_each(s, indexed_log(out, "arrival_seq", "arrival_ts", 5_000), ck, None), n=2)
    ts = F.unix_micros("ts")
    middle = I.events(spark, sf).agg(F.timestamp_micros(F.min(ts) + F.floor((F.max(ts) - F.min(ts)) / 2))).first()[0]
    low, high = spark.read.parquet(f"{out}/data").agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    return replay_indexed(spark, out, raw.schema, "arrival_seq", "arrival_ts", (None, low + (high - low) // 10 * 9), (middle, None))


@query("F6_tiled_history_stream", ORACLES["F6_customer_history"])
def tiled_history_stream(spark, sf):
    """Histories of F6 from tiles, over three micro-batches in the order of event time; tiles older than the longest span are forgotten on the way."""
    out = scratch_path(spark, "histories")
    orders = I.valid_orders(spark, sf, deal=True).select("customer_id", "arrival_seq", "event_time", "amount", F.unix_micros("event_time").alias("_order"))
    write = H.history_batches(out, "customer_id", "event_time", "amount", SPANS, folder=H.DAY)
    replay(orders, lambda s, ck: K.write_each(s, write, ck, None), n=3, order="_order")
    return H.read_histories(spark, out).drop("event_time", "amount", "_order")


@query(
    "T10_sessions_stream",
    sql(
        "SELECT * FROM (SELECT customer_id, min(event_time) AS session_start, max(event_time) + INTERVAL 6 HOUR AS session_end,"
        " count(*) AS total_orders, CAST(sum(amount) AS DOUBLE) AS total_amount FROM ("
        " SELECT *, sum(opens) OVER (PARTITION BY customer_id ORDER BY event_time) AS session FROM ("
        "  SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY customer_id ORDER BY event_time) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens"
        "  FROM valid)) GROUP BY customer_id, session)"
        " WHERE epoch_us(session_end) <= (SELECT max(epoch_us(event_time)) // 1000 * 1000 - 600000000 FROM valid)"
    ),
)
def sessions_stream(spark, sf):
    out = scratch_path(spark, "sessions")

    def start(stream, checkpoint):
        rows = W.with_bounded_lateness(stream)
        return K.write_table(W.sessions_stream(rows, "customer_id", "6 hours"), out, checkpoint, None)

    replay(_valid(spark, sf), start)
    return spark.read.parquet(out)
