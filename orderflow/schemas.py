"""Stage schemas, as DDL strings."""

ORDER_KEYS = [
    "order_id", "customer_id", "amount", "currency", "status", "timestamp", "items_count",
]

RAW_ORDER = (
    "value string, topic string, partition int, arrival_seq bigint, arrival_ts timestamp"
)
ORDER_EVENT = (
    "order_id string, customer_id string, amount decimal(24,6), currency string, status string,"
    " timestamp string, items_count int"
)
ENRICHED_ORDER = (
    ORDER_EVENT + ", region string, tax decimal(18,2), order_value_category string,"
    " merchant_id string, processed_at string, processing_duration_ms bigint"
)
DLQ = (
    "original_message string, error_type string, error_message string,"
    " error_timestamp string, attempted_order_id string"
)
ORDER_AGG = (
    "region string, total_orders bigint, total_amount decimal(38,6), avg_order_value decimal(18,2),"
    " max_order_value decimal(24,6), window_start string, window_end string,"
    " processing_timestamp_ms bigint"
)
TICK = "datetime string, ticker string, price double, volume bigint"
METRIC = "ts timestamp, metric_name string, dims map<string,string>, value double"
LOG_EVENT = (
    "timestamp timestamp, level string, logger string, message string, correlation_id string,"
    " order_id string, customer_id string, session_id string, operator string, latency_ms int,"
    " status string, error_type string, error_code string, error_message string,"
    " environment string, environment_replica string,"
    " context struct<api_endpoint:string,api_latency_ms:int,cache_hit:boolean>"
)
ENVELOPE = "topic string, partition int, offset bigint, timestamp bigint, value string"
