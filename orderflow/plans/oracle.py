"""DuckDB SQL of the derived inputs, shared by the check queries. Unused parts are not evaluated."""

from __future__ import annotations

from orderflow import constants as C

_REGIONS = "['US','EU','UK','CA','AU','ZZ','us']"
_OPERATORS = "['deserialization','validation','enrichment','aggregation','delivery']"
_ERRORS = "[" + ",".join(f"'{t}'" for t in C.LOG_ERROR_TYPES) + "]"
_TICKERS = "[" + ",".join(f"'{t}'" for t in C.TICKERS) + "]"
_STATUS_TEXT = ", ".join(sorted(C.STATUSES))


def half_even(num: str, den: str) -> str:
    """Whole ``num / den`` rounded half to even, for non-negative whole numbers."""
    return (
        f"(({num}) // ({den}) + CASE WHEN 2 * (({num}) % ({den})) > ({den}) OR "
        f"(2 * (({num}) % ({den})) = ({den}) AND (({num}) // ({den})) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def average(total: str, count: str) -> str:
    """Half-even average in cents of a decimal total, in whole numbers."""
    units = f"CAST({total} * 1000000 AS HUGEINT)"
    return f"CAST({half_even(units, f'CAST({count} AS HUGEINT) * 10000')} AS DOUBLE) / 100"


def percentile(value: str, p: float) -> str:
    return f"round(quantile_cont({value}, {p}), 6)"


BASE = f"""
WITH RECURSIVE ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS v FROM events
), copies AS (
  SELECT ev.*, c.copy_no, ts + to_hours([0,3,25,30][c.copy_no + 1]) AS arrival_ts
  FROM ev JOIN (VALUES (0),(1),(2),(3)) c(copy_no)
    ON c.copy_no = 0 OR (c.copy_no = 1 AND event_id % 20 = 3) OR (c.copy_no > 1 AND event_id % 100 = 3)
), texts AS (
  SELECT *, '{{"order_id":"ORD-' || lpad(event_id::VARCHAR, 9, '0') || '","customer_id":'
    || CASE WHEN event_id % 107 = 1 THEN 'null' ELSE '"CUST-' || {_REGIONS}[(user_id % 7 + 1)::INT] || '-' || lpad(user_id::VARCHAR, 6, '0') || '"' END
    || ',"amount":"'
    || CASE WHEN event_id % 61 = 1 THEN 'NaN' WHEN event_id % 103 = 1 THEN 'Infinity'
            WHEN event_id % 97 = 1 THEN '-' || CAST(CAST(v * 10 AS DECIMAL(20,2)) AS VARCHAR)
            WHEN event_id % 101 = 1 THEN '1000000.00'
            WHEN event_id % 53 = 1 THEN CAST(CAST(v * 10 AS DECIMAL(20,2)) AS VARCHAR) || '5'
            ELSE CAST(CAST(v * 10 AS DECIMAL(20,2)) AS VARCHAR) END
    || '","currency":"' || CASE WHEN event_id % 89 = 1 THEN 'ZZZ' ELSE 'USD' END || '"'
    || CASE WHEN event_id % 71 = 1 THEN '' ELSE ',"status":"'
         || CASE WHEN event_id % 83 = 1 THEN 'unknown' WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'shipped' END || '"' END
    || ',"timestamp":'
    || CASE WHEN event_id % 113 = 1 THEN '123' WHEN event_id % 79 = 1 THEN '"not-a-time"'
            ELSE '"' || strftime(ts - CASE WHEN event_id % 50 = 0 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"' END
    || ',"items_count":' || CASE WHEN event_id % 109 = 1 THEN '"x"' ELSE (event_id % 7 + 1)::VARCHAR END
    || CASE WHEN event_id % 67 = 1 THEN ',"extra":1' ELSE '' END || '}}' AS full_text
  FROM copies
), raw AS (
  SELECT CASE WHEN event_id % 73 = 1 THEN left(full_text, length(full_text) - 1) ELSE full_text END AS value,
    '{C.RAW_TOPIC}' AS topic, event_id % 3 AS partition,
    epoch_us(arrival_ts) * 4 + copy_no AS arrival_seq, arrival_ts, event_id
  FROM texts
), docs AS (
  SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM raw
), fields AS (
  SELECT *, json_extract_string(j, '$.order_id') AS f_order, json_extract_string(j, '$.customer_id') AS f_customer,
    json_extract_string(j, '$.amount') AS f_amount, json_extract_string(j, '$.currency') AS f_currency,
    json_extract_string(j, '$.status') AS f_status, json_extract_string(j, '$.timestamp') AS f_timestamp,
    json_extract_string(j, '$.items_count') AS f_items, json_type(j, '$.timestamp') AS t_timestamp,
    json_keys(j) AS k
  FROM docs
), parsed0 AS (
  SELECT *, CASE
    WHEN j IS NULL THEN 'Invalid JSON: text is not one JSON document'
    WHEN json_type(j) <> 'OBJECT' THEN 'Unexpected error: not a JSON object'
    WHEN list_sort(k) <> ['amount','currency','customer_id','items_count','order_id','status','timestamp'] THEN
      'Unexpected error: missing keys ['
      || array_to_string(list_sort(list_filter(['order_id','customer_id','amount','currency','status','timestamp','items_count'], lambda x: NOT list_contains(k, x))), ',')
      || '], extra keys ['
      || array_to_string(list_sort(list_filter(k, lambda x: NOT list_contains(['order_id','customer_id','amount','currency','status','timestamp','items_count'], x))), ',') || ']'
    WHEN TRY_CAST(f_amount AS DOUBLE) IS NULL OR isnan(TRY_CAST(f_amount AS DOUBLE)) THEN 'Unexpected error: amount is not a number'
    WHEN TRY_CAST(f_items AS INT) IS NULL THEN 'Unexpected error: items_count is not a whole number'
    WHEN f_customer IS NULL THEN 'Unexpected error: customer_id is null'
    WHEN t_timestamp <> 'VARCHAR' THEN 'Unexpected error: timestamp is not a text'
    END AS schema_error
  FROM fields
), parsed AS (
  SELECT value, topic, partition, arrival_seq, arrival_ts, event_id, schema_error,
    CASE WHEN schema_error IS NULL THEN f_order END AS order_id,
    CASE WHEN schema_error IS NULL THEN f_customer END AS customer_id,
    CASE WHEN schema_error IS NULL THEN f_currency END AS currency,
    CASE WHEN schema_error IS NULL THEN f_status END AS status,
    CASE WHEN schema_error IS NULL THEN f_timestamp END AS timestamp,
    CASE WHEN schema_error IS NULL THEN f_items::INT END AS items_count,
    CASE WHEN schema_error IS NULL THEN TRY_CAST(f_amount AS DECIMAL(24,6)) END AS amount,
    CASE WHEN schema_error IS NULL THEN TRY_CAST(f_amount AS DOUBLE) END AS amount_double,
    CASE WHEN schema_error IS NULL THEN TRY_CAST(f_timestamp AS TIMESTAMP) END AS event_time
  FROM parsed0
), ruled AS (
  SELECT *,
    CASE WHEN amount_double < 0.01 THEN 'Amount must be >= 0.01' END AS e_min,
    CASE WHEN amount_double > 999999.99 THEN 'Amount must be <= 999999.99' END AS e_max,
    CASE WHEN currency NOT IN ({",".join(f"'{c}'" for c in C.CURRENCIES)}) THEN 'Currency ''' || currency || ''' not supported' END AS e_currency,
    CASE WHEN status NOT IN ({",".join(f"'{c}'" for c in C.STATUSES)}) THEN 'Status ''' || status || ''' invalid; must be one of {_STATUS_TEXT}' END AS e_status,
    CASE WHEN schema_error IS NULL AND event_time IS NULL THEN 'Timestamp ''' || timestamp || ''' not valid ISO-8601' END AS e_time
  FROM parsed
), checked AS (
  SELECT *, CASE WHEN schema_error IS NOT NULL THEN 'SCHEMA_INVALID'
      WHEN coalesce(e_min, e_max, e_currency, e_status, e_time) IS NOT NULL THEN 'BUSINESS_RULE_VIOLATION' END AS error_type,
    coalesce(schema_error, nullif(concat_ws('; ', e_min, e_max, e_currency, e_status, e_time), '')) AS error_message
  FROM ruled
), regioned AS (
  SELECT *, CASE WHEN lower(split_part(customer_id, '-', 2)) IN ('us','eu','uk','ca','au') THEN lower(split_part(customer_id, '-', 2)) ELSE 'ca' END AS region
  FROM checked WHERE error_type IS NULL
), taxed AS (
  SELECT *, CAST(amount * 1000000 AS HUGEINT) * CASE region WHEN 'us' THEN 8 WHEN 'eu' THEN 19 WHEN 'uk' THEN 20 WHEN 'ca' THEN 5 ELSE 10 END AS tax_units
  FROM regioned
), valid AS (
  SELECT value, arrival_seq, arrival_ts, event_id, order_id, customer_id, currency, status, timestamp, items_count, amount, event_time, region,
    CAST({half_even("tax_units", "1000000")} AS DOUBLE) / 100 AS tax,
    CASE WHEN amount < 50 THEN 'small' WHEN amount > 500 THEN 'large' ELSE 'medium' END AS order_value_category,
    'MERCH-' || upper(region) || '-' || lpad((list_sum(list_transform(string_split(customer_id, ''), lambda c: unicode(c))) % 100)::INT::VARCHAR, 3, '0') AS merchant_id,
    arrival_ts + INTERVAL 250 MILLISECOND AS processed_at,
    epoch_ms(arrival_ts + INTERVAL 250 MILLISECOND) - epoch_ms(event_time) AS processing_duration_ms
  FROM taxed
), acc AS (
  SELECT order_id, min(arrival_seq) AS arrival_seq FROM valid GROUP BY order_id
  UNION ALL
  SELECT v.order_id, min(v.arrival_seq) FROM acc JOIN valid v ON v.order_id = acc.order_id
    AND v.arrival_seq // 4 >= acc.arrival_seq // 4 + 86400000000 GROUP BY v.order_id
), flagged AS (
  SELECT v.*, acc.order_id IS NULL AS is_dup FROM valid v LEFT JOIN acc USING (order_id, arrival_seq)
), processed AS (
  SELECT * FROM flagged WHERE NOT is_dup
), ticks AS (
  SELECT date_trunc('second', ts) AS datetime, {_TICKERS}[(user_id % 10 + 1)::INT] AS ticker,
    CAST(v + 50 AS DOUBLE) AS price, event_id % 1000 AS volume, event_id FROM ev
), logs AS (
  SELECT ts AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    'order ' || event_type AS message, 'ORD-' || lpad((event_id // 5)::VARCHAR, 9, '0') AS order_id,
    md5('ORD-' || lpad((event_id // 5)::VARCHAR, 9, '0')) AS correlation_id,
    'CUST-' || {_REGIONS}[(user_id % 7 + 1)::INT] || '-' || lpad(user_id::VARCHAR, 6, '0') AS customer_id,
    {_OPERATORS}[(event_id % 5 + 1)::INT] AS operator, CAST(floor(v * 20) AS BIGINT) AS latency_ms,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    CASE WHEN event_type = 'error' THEN {_ERRORS}[(user_id % 5 + 1)::INT] END AS error_type,
    CAST(floor(v * 10) AS BIGINT) AS api_latency_ms, event_id % 3 <> 0 AS cache_hit, event_id
  FROM ev
), metrics AS (
  SELECT ts, event_id, ['DLQRecordCount','checkpoint_failures_total','kafka_broker_alive_count','firehose_failed_put_count',
      'consumer_lag_records','LatencyP99','WindowCompleteness','memory_usage_percentage','checkpoint_duration_ms',
      'DuplicateRecordDetected','kafka_deserialization_errors_total'][(event_id % 11 + 1)::INT] AS metric_name,
    CASE event_id % 11 WHEN 0 THEN CAST(v AS DOUBLE) WHEN 1 THEN floor(v / 300) WHEN 2 THEN 3 - floor(v / 200)
      WHEN 3 THEN floor(v / 350) WHEN 4 THEN CAST(v * 300 AS DOUBLE) WHEN 5 THEN CAST(v * 20 AS DOUBLE)
      WHEN 6 THEN CAST(100 - v * 0.05 AS DOUBLE) WHEN 7 THEN CAST(50 + v * 0.125 AS DOUBLE)
      WHEN 8 THEN CAST(v * 150 AS DOUBLE) WHEN 9 THEN CAST(v * 0.1 AS DOUBLE)
      ELSE CAST(v * 0.025 AS DOUBLE) END AS value
  FROM ev
), snaps AS (
  SELECT date_trunc('hour', ts) AS ts, '{C.RAW_TOPIC}' AS topic, event_id % 3 AS partition,
    max(event_id // 3) + 1000001 AS log_end_offset,
    max(event_id // 3) + 1000001 - CAST(sum(CAST(v * 100 AS BIGINT)) % 60000 AS BIGINT) AS current_offset
  FROM ev GROUP BY 1, 3
), late AS (
  SELECT *, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start,
    epoch_us(time_bucket(INTERVAL 5 MINUTE, event_time)) + 900000000 <=
    coalesce(max(epoch_us(event_time)) OVER (ORDER BY arrival_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_late
  FROM processed
), region_windows AS (
  SELECT region, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, count(*) AS total_orders,
    sum(amount) AS total_amount, max(amount) AS max_order_value
  FROM processed GROUP BY 1, 2
)
"""


def sql(select: str) -> str:
    return BASE + select
