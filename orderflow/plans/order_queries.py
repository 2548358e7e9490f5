"""Sources, parsing, validation, enrichment and de-duplication over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions import scalar as S
from orderflow.operators import dedup as D
from orderflow.operators import enrich as E
from orderflow.operators import validate as V
from orderflow.operators import windows as W
from orderflow.plans import inputs as I
from orderflow.plans.oracle import average, sql
from orderflow.plans.registry import query
from orderflow.sources import orders as R

_ERROR_TS = "strftime(arrival_ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


# --- sources ---------------------------------------------------------------------------------


@query("S2_read_orders_batch", sql("SELECT value, topic, partition, arrival_seq, arrival_ts FROM raw"))
def read_orders_batch(spark, sf):
    """Raw order texts written as a bounded table and read back with their arrival order."""
    raw = I.raw_orders(spark, sf)
    path = I.scratch_path(spark, "raw")
    raw.write.parquet(path)
    return R.read_orders_batch(spark, {"files": path, "schema": raw.schema})


def _envelopes(spark, sf):
    """Broker times so coarse that copies of an order share one, offsets equal modulo 4, and copies in several partitions."""
    raw = I.raw_orders(spark, sf)
    return raw.select(
        F.to_binary("value", F.lit("utf-8")).alias("value"), "topic",
        ((F.col("partition") + F.col("arrival_seq") % 4) % 3).cast("int").alias("partition"),
        (F.col("arrival_seq") * 4).alias("offset"), F.date_trunc("day", "arrival_ts").alias("timestamp"),
    )


_ENVELOPES = "date_trunc('day', arrival_ts)::TIMESTAMP AS t, (partition + arrival_seq % 4) % 3 AS part, arrival_seq * 4 AS pos"


@query(
    "S3_read_envelopes",
    sql(
        f"SELECT value, topic, part::BIGINT AS partition, pos AS \"offset\", t AS arrival_ts,"
        f" '{{\"partition\":' || part || ',\"offset\":' || pos || '}}' AS arrival_seq FROM (SELECT *, {_ENVELOPES} FROM raw)"
    ),
)
def read_envelopes(spark, sf):
    return R.read_envelopes(_envelopes(spark, sf))


@query(
    "S3_first_of_envelopes",
    sql(
        f", ranked AS (SELECT order_id, t, part, pos, row_number() OVER (PARTITION BY order_id ORDER BY t, part, pos) AS rn FROM"
        f" (SELECT order_id, {_ENVELOPES.replace('arrival_seq', 'v.arrival_seq').replace('arrival_ts', 'v.arrival_ts')} FROM valid v JOIN raw r ON r.arrival_seq = v.arrival_seq AND r.event_id = v.event_id)"
        "), won AS (SELECT order_id, t, rn FROM ranked WHERE rn = 1 UNION ALL"
        " SELECT r.order_id, min(r.t), min(r.rn) FROM won JOIN ranked r ON r.order_id = won.order_id AND epoch_us(r.t) >= epoch_us(won.t) + 86400000000 GROUP BY r.order_id)"
        " SELECT r.order_id, r.part::BIGINT AS partition, r.pos AS \"offset\", won.rn IS NULL AS is_dup FROM ranked r LEFT JOIN won USING (order_id, rn)"
    ),
)
def first_of_envelopes(spark, sf):
    """De-duplication in the order of (time, partition, offset), where many records share a time."""
    valid = V.route(V.validate_orders(R.read_envelopes(_envelopes(spark, sf))))[0]
    slim = I.staged(valid.select("order_id", "arrival_ts", "arrival_seq"), "envelopes")
    return D.flag_duplicates(slim).select("order_id", "arrival_seq.partition", "arrival_seq.offset", "is_dup")


@query(
    "S4_explode_captured_batch",
    sql(
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ticks-0' WHEN 1 THEN 'ticks-1' END AS topic_partition,"
        " ticker, price FROM ticks"
        " UNION ALL SELECT event_id, 'ticks-1', ticker, price FROM ticks WHERE event_id % 4 = 1"
    ),
)
def explode_captured_batch(spark, sf):
    """Captured batches in all three shapes; each also holds a record that cannot be decoded."""
    t = I.tick_texts(spark, sf)
    e = F.col("event_id")
    coded = F.regexp_replace(F.base64(F.to_binary("value", F.lit("utf-8"))), r"\s", "")
    good = F.concat(F.lit('{"value":"'), coded, F.lit('"}'))
    bad = F.lit('{"value":"%%%"}')
    batch = (
        F.when(e % 4 == 0, F.concat(F.lit('{"records":{"ticks-0":['), good, F.lit(","), bad, F.lit("]}}")))
        .when(e % 4 == 1, F.concat(F.lit('{"records":{"ticks-1":['), good, F.lit(","), good, F.lit("]}}")))
        .when(e % 4 == 2, F.concat(F.lit("["), F.col("value"), F.lit("]")))
        .otherwise(F.col("value"))
    )
    records = R.explode_captured_batch(t.select("event_id", batch.alias("value")))
    parsed = R.parse_ticks(records, "payload")
    return parsed.select("event_id", "topic_partition", "ticker", "price")


@query(
    "S5_read_ticks",
    sql(
        "SELECT event_id, datetime, CASE WHEN event_id % 50 <> 7 THEN ticker END AS ticker, price, volume, 'tick' AS kind FROM ticks WHERE event_id % 31 <> 5"
        " UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 'malformed' FROM ticks WHERE event_id % 31 = 5"
    ),
)
def read_ticks(spark, sf):
    """Ticks, some without a ticker, and the texts that are none."""
    nameless = F.regexp_replace("value", '"ticker":"[A-Z]+",', "")
    e = F.col("event_id")
    texts = I.tick_texts(spark, sf).withColumn(
        "value", F.when(e % 31 == 5, F.substring("value", 2, 1000)).when(e % 50 == 7, nameless).otherwise(F.col("value"))
    )
    ticks = R.parse_ticks(texts).withColumn("kind", F.lit("tick"))
    bad = R.malformed_ticks(texts).select("event_id", F.lit("malformed").alias("kind"))
    return ticks.unionByName(bad, allowMissingColumns=True)


@query(
    "S7_read_reference",
    "SELECT o_orderkey, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey",
)
def read_reference(spark, sf):
    ref = R.read_reference(spark, f"{sf}/customer.parquet", "c_custkey")
    orders = I.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found, _ = E.enrich_reference(orders, ref, "c_custkey", ["c_mktsegment", "c_nationkey"])
    return found.select("o_orderkey", "c_mktsegment", "c_nationkey")


@query(
    "S7_repeated_keys",
    "SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment, c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer"
    " QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal, c_custkey) = 1",
)
def repeated_keys(spark, sf):
    """A lookup table by a key that repeats: one whole row per key."""
    rows = I.table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal", "c_custkey")
    return R.one_per_key(rows, "c_nationkey")


@query(
    "S8_read_log_events",
    sql(
        "SELECT timestamp, level, order_id, correlation_id, customer_id, operator, latency_ms, status, error_type,"
        " api_latency_ms, cache_hit FROM logs"
    ),
)
def read_log_events(spark, sf):
    path = I.scratch_path(spark, "logs")
    I.log_lines(spark, sf).write.text(path)
    return R.read_log_events(spark, path).select(
        "timestamp", "level", "order_id", "correlation_id", "customer_id", "operator", "latency_ms",
        "status", "error_type", "context.api_latency_ms", "context.cache_hit",
    )


# --- parse, validate, route -------------------------------------------------------------------


@query(
    "V1_parse_orders",
    sql(
        "SELECT arrival_seq, order_id, customer_id, CAST(amount AS DOUBLE) AS amount, currency, status, timestamp,"
        " items_count::BIGINT AS items_count, event_time FROM parsed"
    ),
)
def parse_orders(spark, sf):
    return V.parse_orders(I.raw_orders(spark, sf)).select(
        "arrival_seq", "order_id", "customer_id", "amount", "currency", "status", "timestamp",
        "items_count", "event_time",
    )


@query("V2_classify_schema_errors", sql("SELECT arrival_seq, schema_error FROM parsed WHERE schema_error IS NOT NULL"))
def classify_schema_errors(spark, sf):
    parsed = V.parse_orders(I.raw_orders(spark, sf))
    return parsed.filter(F.col("schema_error").isNotNull()).select("arrival_seq", "schema_error")


def _rule(name, rule, column):
    @query(name, sql(f"SELECT arrival_seq, {column} AS message FROM ruled WHERE {column} IS NOT NULL"))
    def one_rule(spark, sf):
        parsed = V.parse_orders(I.raw_orders(spark, sf)).filter(F.col("schema_error").isNull())
        return parsed.select("arrival_seq", rule().alias("message")).filter(
            F.col("message").isNotNull()
        )


_rule("V3_rule_min_amount", V.rule_min_amount, "e_min")
_rule("V4_rule_max_amount", V.rule_max_amount, "e_max")
_rule("V5_rule_currency", V.rule_currency, "e_currency")
_rule("V6_rule_status", V.rule_status, "e_status")
_rule("V7_rule_timestamp", V.rule_timestamp, "e_time")


@query(
    "V8_collect_errors",
    sql(
        "SELECT arrival_seq, concat_ws('; ', e_min, e_max, e_currency, e_status, e_time) AS error_message"
        " FROM ruled WHERE schema_error IS NULL"
    ),
)
def collect_errors(spark, sf):
    checked = V.collect_errors(V.parse_orders(I.raw_orders(spark, sf)))
    return checked.filter(F.col("schema_error").isNull()).select(
        "arrival_seq", F.array_join("errors", "; ").alias("error_message")
    )


def _longer(raw):
    """Every seventh text is over 12,000 characters long, and all that matters stands at its end."""
    long = F.concat(F.repeat(F.lit(" "), F.lit(12_000)), F.col("value"))
    return raw.withColumn("value", F.when(F.col("arrival_seq") % 7 == 0, long).otherwise(F.col("value")))


_DLQ_SELECT = (
    f"SELECT left(text, 10000) AS original_message, text AS full_message, error_type, error_message, {_ERROR_TS} AS error_timestamp,"
    " CASE WHEN error_type <> 'SCHEMA_INVALID' THEN order_id END AS attempted_order_id"
    " FROM (SELECT *, CASE WHEN arrival_seq % 7 = 0 THEN repeat(' ', 12000) || value ELSE value END AS text FROM checked WHERE error_type IS NOT NULL)"
)


@query("V9_to_dlq", sql(_DLQ_SELECT))
def to_dlq(spark, sf):
    """Dead letters with the wire message and the whole text."""
    bad = V.route(V.validate_orders(_longer(I.raw_orders(spark, sf))))[1]
    return V.to_dlq(bad, S.iso_text(F.col("arrival_ts")))


@query("V10_route", sql("SELECT arrival_seq, CASE WHEN error_type IS NULL THEN 'ok' ELSE 'bad' END AS side FROM checked"))
def route(spark, sf):
    ok, bad = V.route(I.staged(I.validated(spark, sf).select("arrival_seq", "error_type"), "judged"))
    return ok.select("arrival_seq", F.lit("ok").alias("side")).unionByName(
        bad.select("arrival_seq", F.lit("bad").alias("side"))
    )


@query(
    "V11_union_dlq",
    sql(
        "SELECT error_type, attempted_order_id, error_message, count(*) AS n FROM ("
        " SELECT error_type, CASE WHEN error_type <> 'SCHEMA_INVALID' THEN order_id END AS attempted_order_id, error_message"
        " FROM checked WHERE error_type IS NOT NULL UNION ALL"
        " SELECT 'DUPLICATE', order_id, 'Order ' || order_id || ' already processed within deduplication window'"
        " FROM flagged WHERE is_dup) GROUP BY ALL"
    ),
)
def union_dlq(spark, sf):
    at = S.iso_text(F.col("arrival_ts"))
    checked = I.checked_table(spark, sf)
    rejected = V.to_dlq(V.route(checked)[1], at)
    repeated = D.duplicates_to_dlq(I.flagged_orders(spark, sf, checked), F.lit(None).cast("string"))
    return (
        V.union_dlq(rejected, repeated)
        .groupBy("error_type", "attempted_order_id", "error_message")
        .agg(F.count("*").alias("n"))
    )


@query(
    "V12_validate_ticks",
    sql(
        "SELECT event_id, concat_ws('; ',"
        " CASE WHEN ticker = 'INTC' THEN 'Unknown ticker INTC' END,"
        " CASE WHEN event_id % 11 = 0 THEN 'Price is not a number' END,"
        " CASE WHEN datetime < TIMESTAMP '2024-01-02' THEN 'Timestamp is too old' END) AS errors FROM ticks"
    ),
)
def validate_ticks(spark, sf):
    t = I.ticks(spark, sf).select(
        "event_id",
        F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
        "ticker",
        F.when(F.col("event_id") % 11 == 0, "N/A").otherwise(F.col("price").cast("string")).alias("price"),
    )
    known = [x for x in C.TICKERS if x != "INTC"]
    return V.validate_ticks(t, known, "2024-01-02T00:00:00Z").select(
        "event_id", F.array_join("errors", "; ").alias("errors")
    )


def _renamed(raw):
    """Every third text uses another name for ``customer_id``."""
    other = F.regexp_replace("value", '"customer_id":', '"cust_id":')
    return raw.withColumn(
        "value", F.when(F.col("arrival_seq") % 3 == 0, other).otherwise(F.col("value"))
    )


@query(
    "V13_parse_tolerant",
    sql("SELECT arrival_seq, order_id, customer_id, CAST(amount AS DOUBLE) AS amount, event_time, schema_error FROM parsed"),
)
def parse_tolerant(spark, sf):
    """Every third text uses the old field name; parsing must not depend on it."""
    fixed = V.parse_tolerant(_renamed(I.raw_orders(spark, sf)), {"customer_id": ["cust_id"]})
    return V.parse_orders(fixed).select(
        "arrival_seq", "order_id", "customer_id", "amount", "event_time", "schema_error"
    )


@query(
    "V14_replay_dlq",
    sql(
        "SELECT first_error_type, CASE WHEN error_type IS NULL THEN 'recovered' ELSE 'still bad' END AS side, count(*) AS n"
        " FROM (SELECT CASE WHEN arrival_seq % 3 = 0 THEN 'SCHEMA_INVALID' ELSE error_type END AS first_error_type, error_type FROM checked)"
        " WHERE first_error_type IS NOT NULL GROUP BY ALL"
    ),
)
def replay_dlq(spark, sf):
    """A renamed field sends good orders to the dead letters; the fixed parser recovers them, also where the wire
    message has only the first characters of a long text."""
    raw = _longer(_renamed(I.raw_orders(spark, sf)))
    dlq = V.to_dlq(V.route(V.validate_orders(raw))[1], S.iso_text(F.col("arrival_ts")))
    good, bad = V.replay_dlq(dlq, {"customer_id": ["cust_id"]})
    sides = good.select("first_error_type", F.lit("recovered").alias("side")).unionByName(
        bad.select("first_error_type", F.lit("still bad").alias("side"))
    )
    return sides.groupBy("first_error_type", "side").agg(F.count("*").alias("n"))


@query(
    "V15_map_error_types",
    sql(
        "SELECT error_type, CASE error_type WHEN 'SCHEMA_INVALID' THEN 'parse_error' ELSE 'validation_error' END AS error_name,"
        " count(*) AS n FROM checked WHERE error_type IS NOT NULL GROUP BY ALL"
    ),
)
def map_error_types(spark, sf):
    bad = V.route(I.validated(spark, sf))[1]
    return V.map_error_types(bad).groupBy("error_type", "error_name").agg(F.count("*").alias("n"))


# --- enrichment -------------------------------------------------------------------------------


@query("E1_with_region", sql("SELECT arrival_seq, customer_id, region FROM valid"))
def with_region(spark, sf):
    return E.with_region(V.route(I.validated(spark, sf))[0]).select(
        "arrival_seq", "customer_id", "region"
    )


@query("E2_with_tax", sql("SELECT arrival_seq, CAST(amount AS DOUBLE) AS amount, tax FROM valid"))
def with_tax(spark, sf):
    df = E.with_region(V.route(I.validated(spark, sf))[0])
    return E.with_tax(df, E.tax_rates(df)).select("arrival_seq", "amount", "tax")


@query("E3_with_value_category", sql("SELECT arrival_seq, order_value_category FROM valid"))
def with_value_category(spark, sf):
    return E.with_value_category(V.route(I.validated(spark, sf))[0]).select(
        "arrival_seq", "order_value_category"
    )


@query("E4_with_merchant", sql("SELECT arrival_seq, merchant_id FROM valid"))
def with_merchant(spark, sf):
    return E.with_merchant(E.with_region(V.route(I.validated(spark, sf))[0])).select(
        "arrival_seq", "merchant_id"
    )


@query("E5_with_processed_at", sql("SELECT arrival_seq, processed_at FROM valid"))
def with_processed_at(spark, sf):
    ok = V.route(I.validated(spark, sf))[0]
    return E.with_processed_at(ok, I.processed_at()).select("arrival_seq", "processed_at")


@query(
    "E6_with_processing_duration",
    sql("SELECT arrival_seq, processing_duration_ms, processing_duration_ms > 1000 AS is_slow FROM valid"),
)
def with_processing_duration(spark, sf):
    return I.valid_orders(spark, sf).select("arrival_seq", "processing_duration_ms", "is_slow")


@query(
    "E7_enrich_reference",
    sql(
        "SELECT event_id, c_name AS company_name, CASE WHEN c_name IS NULL THEN 'No reference row for custkey ' || ev.user_id * 11 END AS error_message"
        " FROM ev LEFT JOIN customer ON c_custkey = ev.user_id * 11"
    ),
)
def enrich_reference(spark, sf):
    """Events looked up in the customer table; those without a row go to the enrichment DLQ."""
    ev = I.events(spark, sf).select("event_id", (F.col("user_id") * 11).alias("custkey"))
    ref = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("company_name")
    )
    return E.with_reference(ev, ref, "custkey", ["company_name"]).select("event_id", "company_name", "error_message")


@query(
    "E8_with_correlation_id",
    sql("SELECT event_id, md5(ticker || '_' || strftime(datetime, '%Y-%m-%dT%H:%M:%SZ')) AS correlation_id FROM ticks"),
)
def with_correlation_id(spark, sf):
    t = I.ticks(spark, sf).withColumn(
        "at", F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    return E.with_correlation_id(t, "ticker", "at").select("event_id", "correlation_id")


_WIRE = (
    "'{\"order_id\":\"' || order_id || '\",\"customer_id\":\"' || customer_id || '\",\"amount\":\"'"
    " || regexp_replace(CAST(amount AS VARCHAR), '(\\.\\d\\d\\d*?)0+$', '\\1') || '\",\"currency\":\"' || currency"
    " || '\",\"status\":\"' || status || '\",\"timestamp\":\"' || timestamp || '\",\"items_count\":' || items_count"
    " || ',\"region\":\"' || region || '\",\"tax\":\"' || CAST(CAST(tax AS DECIMAL(18,2)) AS VARCHAR)"
    " || '\",\"order_value_category\":\"' || order_value_category || '\",\"merchant_id\":\"' || merchant_id"
    " || '\",\"processed_at\":\"' || strftime(processed_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z\",\"processing_duration_ms\":'"
    " || processing_duration_ms || '}'"
)


@query("E9_to_wire_json", sql(f"SELECT arrival_seq, {_WIRE} AS value FROM valid"))
def to_wire_json(spark, sf):
    return E.to_wire_json(I.valid_orders(spark, sf), "enriched", into="wire").select(
        "arrival_seq", F.col("wire").alias("value")
    )


@query(
    "E9_dlq_wire_json",
    sql(
        "SELECT arrival_seq, '{\"original_message\":' || to_json(left(value, 10000))::VARCHAR || ',\"error_type\":\"' || error_type || '\",\"error_message\":'"
        f" || to_json(error_message)::VARCHAR || ',\"error_timestamp\":\"' || {_ERROR_TS} || '\",\"attempted_order_id\":'"
        " || CASE WHEN error_type <> 'SCHEMA_INVALID' THEN '\"' || order_id || '\"' ELSE 'null' END || '}' AS value FROM checked WHERE error_type IS NOT NULL"
    ),
)
def dlq_wire_json(spark, sf):
    """Dead letters as messages; the whole text stays in the table."""
    bad = V.route(I.validated(spark, sf))[1]
    dlq = V.to_dlq(bad, S.iso_text(F.col("arrival_ts")), keep=("arrival_seq",))
    return E.to_wire_json(dlq, "dlq", into="wire").select("arrival_seq", F.col("wire").alias("value"))


@query(
    "E9_aggregate_wire_json",
    sql(
        "SELECT '{\"region\":\"' || region || '\",\"total_orders\":' || total_orders || ',\"total_amount\":\"' || regexp_replace(CAST(CAST(total_amount AS DECIMAL(38,6)) AS VARCHAR), '(\\.\\d\\d\\d*?)0+$', '\\1')"
        f" || '\",\"avg_order_value\":\"' || CAST(CAST({average('total_amount', 'total_orders')} AS DECIMAL(18,2)) AS VARCHAR)"
        " || '\",\"max_order_value\":\"' || regexp_replace(CAST(max_order_value AS VARCHAR), '(\\.\\d\\d\\d*?)0+$', '\\1')"
        " || '\",\"window_start\":\"' || strftime(window_start, '%Y-%m-%dT%H:%M:%S.%f') || 'Z\",\"window_end\":\"' || strftime(window_start + INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M:%S.%f')"
        " || 'Z\",\"processing_timestamp_ms\":' || epoch_ms(window_start + INTERVAL 15 MINUTE) || '}' AS value FROM region_windows"
    ),
)
def aggregate_wire_json(spark, sf):
    closes = F.timestamp_seconds(F.unix_seconds("window_end") + 600)
    metrics = W.region_window_metrics(I.processed_orders(spark, sf, columns=["event_time", "region", "amount"]), emitted_at=closes)
    return E.to_wire_json(metrics, "aggregate").select("value")


@query(
    "E10_from_wire_json",
    sql(
        "SELECT order_id, customer_id, CAST(amount AS DOUBLE) AS amount, tax, items_count::BIGINT AS items_count, region,"
        " merchant_id, processing_duration_ms FROM valid"
    ),
)
def from_wire_json(spark, sf):
    texts = E.to_wire_json(I.valid_orders(spark, sf), "enriched", into="wire").select("wire")
    return E.from_wire_json(texts, "enriched", "wire").select(
        "order_id", "customer_id", "amount", "tax", "items_count", "region", "merchant_id",
        "processing_duration_ms",
    )


@query(
    "E11_epoch_iso",
    "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_iso FROM events",
)
def epoch_iso(spark, sf):
    return E.epoch_iso(I.events(spark, sf), "ts").select("event_id", "ts_ms", "ts_iso")


@query(
    "E12_to_feature_record",
    sql(
        "SELECT event_id, u.f.name AS \"FeatureName\", u.f.val AS \"ValueAsString\" FROM ("
        " SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE ticker END AS tk,"
        "  CASE WHEN event_id % 7 = 0 THEN '0.0' ELSE CAST(price AS DECIMAL(18,2))::VARCHAR END AS pr,"
        "  CASE WHEN event_id % 13 = 0 THEN '' ELSE strftime(datetime, '%Y-%m-%dT%H:%M:%SZ') END AS dt FROM ticks) x,"
        " unnest([{'name': 'id', 'val': md5(tk || '_' || dt)}, {'name': 'ticker', 'val': tk}, {'name': 'price', 'val': pr},"
        " {'name': 'datetime', 'val': dt}, {'name': 'event_time', 'val': CASE WHEN dt = '' THEN '2024-02-01T00:00:00Z' ELSE dt END}]) u(f)"
    ),
)
def to_feature_record(spark, sf):
    """Ticks with missing fields, so that every default is used."""
    from orderflow.operators.features import long_features
    from orderflow.operators.features import to_feature_record as build

    e = F.col("event_id")
    t = I.ticks(spark, sf).select(
        "event_id",
        F.when(e % 5 != 0, F.col("ticker")).alias("ticker"),
        F.when(e % 7 != 0, F.col("price").cast("decimal(18,2)")).alias("price"),
        F.when(e % 13 != 0, F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("datetime"),
    )
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    records = build(t, now, keep=["event_id"])
    return long_features(records, key="event_id")


@query(
    "E13_items_count_check",
    "SELECT o_orderkey, o_orderkey % 7 + 1 AS items_count, coalesce(n, 0) AS actual_items FROM orders"
    " LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
    " WHERE o_orderkey % 7 + 1 <> coalesce(n, 0)",
)
def items_count_check(spark, sf):
    orders = I.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("items_count")
    )
    return E.items_count_check(
        orders, I.table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "items_count"
    )


# --- de-duplication ---------------------------------------------------------------------------


@query("D1_dedup_first", sql("SELECT order_id, arrival_seq, region, CAST(amount AS DOUBLE) AS amount FROM processed"))
def dedup_first(spark, sf):
    return I.processed_orders(spark, sf, columns=["region", "amount"]).select("order_id", "arrival_seq", "region", "amount")


@query(
    "D2_emit_duplicates",
    sql(
        f"SELECT {_WIRE} AS original_message, {_WIRE} AS full_message, 'DUPLICATE' AS error_type,"
        " 'Order ' || order_id || ' already processed within deduplication window' AS error_message,"
        " order_id AS attempted_order_id FROM flagged WHERE is_dup"
    ),
)
def emit_duplicates(spark, sf):
    return D.duplicates_to_dlq(I.flagged_orders(spark, sf), F.current_timestamp()).drop(
        "error_timestamp"
    )


@query(
    "D4_duplicate_counts",
    sql(
        "SELECT date_trunc('minute', arrival_ts) AS minute, count(*) AS duplicates, count(*) > 10 AS breach"
        " FROM flagged WHERE is_dup GROUP BY 1"
    ),
)
def duplicate_counts(spark, sf):
    return D.duplicate_counts(I.flagged_orders(spark, sf, columns=[]))

