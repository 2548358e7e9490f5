"""The streams the operators work on, derived from the given tables without a clock or randomness.

Every row of a table takes part; the remainders below decide which fault a row carries, never
whether it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.operators.dedup import flag_duplicates
from orderflow.operators.enrich import enrich_orders
from orderflow.operators.validate import route, validate_orders
from orderflow.session import scratch_path, stage  # noqa: F401
from orderflow.sources.orders import parse_log_events

REGION_CODES = ["US", "EU", "UK", "CA", "AU", "ZZ", "us"]
OPERATORS = ["deserialization", "validation", "enrichment", "aggregation", "delivery"]
# Hours after the event at which copy 0, 1, 2, 3 of an order arrives.
COPY_HOURS = [0, 3, 25, 30]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, its zone-free times read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(
        *[
            F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def events(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    return with_amount(spread(table(spark, sf_dir, "events"), deal))


def spread(df: DataFrame, deal: bool = False) -> DataFrame:
    """Deal the input over ``orderflow.input.partitions`` tasks where a session sets that, as the benchmark does for its
    one small file. Without it files are read as they are split, or with ``deal`` go over two tasks a core: a range of time out of
    them then has rows in every task, however the files are laid out."""
    tasks = df.sparkSession.conf.get("orderflow.input.partitions", None)
    if not tasks and deal:
        tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(tasks)) if tasks else df


def with_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("value").cast("decimal(18,2)")).drop("value", "props")


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def pick(values: list[str], index: str) -> Column:
    return F.expr(f"get({_array(values)}, cast({index} as int))")


CUSTOMER = f"concat('CUST-', get({_array(REGION_CODES)}, cast(user_id % 7 as int)), '-', lpad(cast(user_id as string), 6, '0'))"


def order_id_of(number: Column) -> Column:
    return F.concat(F.lit("ORD-"), F.lpad(number.cast("string"), 9, "0"))


# Order JSON of an event, with the faults of real producers mixed in.
_AMOUNT = "cast(v * 10 as string)"
_WHOLE_TEXT = f"""concat(
  '{{"order_id":"ORD-', lpad(cast(event_id as string), 9, '0'),
  '","customer_id":', if(event_id % 107 = 1, 'null', concat('"', {CUSTOMER}, '"')),
  ',"amount":"', case
     when event_id % 61 = 1 then 'NaN' when event_id % 103 = 1 then 'Infinity'
     when event_id % 97 = 1 then concat('-', {_AMOUNT}) when event_id % 101 = 1 then '1000000.00'
     when event_id % 53 = 1 then concat({_AMOUNT}, '5') else {_AMOUNT} end,
  '","currency":"', if(event_id % 89 = 1, 'ZZZ', 'USD'), '"',
  if(event_id % 71 = 1, '', concat(',"status":"', case
     when event_id % 83 = 1 then 'unknown' when event_type = 'purchase' then 'confirmed'
     else 'shipped' end, '"')),
  ',"timestamp":', case
     when event_id % 113 = 1 then '123' when event_id % 79 = 1 then '"not-a-time"'
     else concat('"', date_format(ts - if(event_id % 50 = 0, interval 30 minutes, interval 0 minutes),
                                  "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z"') end,
  ',"items_count":', if(event_id % 109 = 1, '"x"', cast(event_id % 7 + 1 as string)),
  if(event_id % 67 = 1, ',"extra":1', ''), '}}')"""


def raw_orders_of(ev: DataFrame) -> DataFrame:
    """Raw order texts with their arrival; every 20th order is re-sent, some past the memory."""
    copies = "case when event_id % 100 = 3 then array(0, 1, 2, 3) when event_id % 20 = 3 then array(0, 1) else array(0) end"
    hours = ", ".join(map(str, COPY_HOURS))
    return ev.selectExpr("*", f"explode({copies}) as copy_no").selectExpr(
        "*",
        f"timestamp_micros(unix_micros(ts) + array({hours})[copy_no] * 3600000000L) as arrival_ts",
        f"{_WHOLE_TEXT} as whole_text",
    ).selectExpr(
        "if(event_id % 73 = 1, substring(whole_text, 1, length(whole_text) - 1), whole_text) as value",
        f"'{C.RAW_TOPIC}' as topic",
        "cast(event_id % 3 as int) as partition",
        "unix_micros(arrival_ts) * 4 + copy_no as arrival_seq",
        "arrival_ts",
    )


def raw_orders(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    return raw_orders_of(events(spark, sf_dir, deal))


def validated(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    return validate_orders(raw_orders(spark, sf_dir, deal))


def processed_at() -> Column:
    """A quarter second after arrival stands in for the clock."""
    return F.timestamp_micros(F.unix_micros("arrival_ts") + F.lit(250_000))


def valid_orders(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Valid orders, enriched, duplicates still in."""
    return enrich_orders(route(validated(spark, sf_dir, deal))[0], processed_at())


staged = stage


VALID_COLUMNS = [
    "order_id", "customer_id", "amount", "currency", "status", "timestamp", "items_count",
    "event_time", "arrival_ts", "arrival_seq", "region", "tax", "order_value_category",
    "merchant_id", "processed_at", "processing_duration_ms",
]


def checked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw record once, parsed, judged and enriched, as a table: one parse serves all readers."""
    checked = enrich_orders(validated(spark, sf_dir), processed_at())
    return staged(checked.select("value", *VALID_COLUMNS, "error_type", "error_message"), "checked")


_ARRIVAL = ["order_id", "arrival_ts", "arrival_seq"]


def flagged_orders(
    spark: SparkSession, sf_dir: str, checked: DataFrame | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Valid orders with ``is_dup``: all columns, or the arrival and ``columns``, which is all that is then computed and staged."""
    wanted = VALID_COLUMNS if columns is None else list(dict.fromkeys([*_ARRIVAL, *columns]))
    if checked is None:
        valid = staged(valid_orders(spark, sf_dir).select(*wanted), "valid")
    else:
        valid = route(checked)[0].select(*wanted)
    return flag_duplicates(valid)


def processed_orders(
    spark: SparkSession, sf_dir: str, checked: DataFrame | None = None, columns: list[str] | None = None
) -> DataFrame:
    return flagged_orders(spark, sf_dir, checked, columns).filter(~F.col("is_dup")).drop("is_dup")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.date_trunc("second", "ts").alias("datetime"),
        pick(C.TICKERS, "user_id % 10").alias("ticker"),
        (F.col("v") + 50).cast("double").alias("price"),
        (F.col("event_id") % 1000).alias("volume"),
        "event_id",
    )


def tick_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.select(
        "event_id",
        F.to_json(
            F.struct(
                F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
                "ticker", "price", "volume",
            )
        ).alias("value"),
    )


_LOG_RECORD = f"""struct(
  concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z') as timestamp,
  if(event_type = 'error', 'ERROR', 'INFO') as level, 'order_processor' as logger,
  concat('order ', event_type) as message, md5(order_id) as correlation_id, order_id,
  {CUSTOMER} as customer_id, concat('sess-', user_id) as session_id,
  get({_array(OPERATORS)}, cast(event_id % 5 as int)) as operator,
  cast(floor(v * 20) as int) as latency_ms,
  if(event_type = 'error', 'error', 'success') as status,
  if(event_type = 'error', get({_array(C.LOG_ERROR_TYPES)}, cast(user_id % 5 as int)), null) as error_type,
  if(event_type = 'error', 'ERR-001', null) as error_code,
  if(event_type = 'error', 'failed', null) as error_message,
  'prod' as environment, concat('order-processor-', event_id % 4) as environment_replica,
  struct(concat('/v1/customers/', user_id) as api_endpoint,
         cast(floor(v * 10) as int) as api_latency_ms, event_id % 3 <> 0 as cache_hit) as context)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).selectExpr(
        "*", "concat('ORD-', lpad(cast(floor(event_id / 5) as string), 9, '0')) as order_id"
    )
    return ev.selectExpr(f"to_json({_LOG_RECORD}) as value")


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed log events as a table, for operators that read their input more than once."""
    return staged(log_events(spark, sf_dir), "log-events")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_log_events(log_lines(spark, sf_dir))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [
        ("DLQRecordCount", "v"),
        ("checkpoint_failures_total", "floor(v / 300)"),
        ("kafka_broker_alive_count", "3 - floor(v / 200)"),
        ("firehose_failed_put_count", "floor(v / 350)"),
        ("consumer_lag_records", "v * 300"),
        ("LatencyP99", "v * 20"),
        ("WindowCompleteness", "100 - v * 0.05"),
        ("memory_usage_percentage", "50 + v * 0.125"),
        ("checkpoint_duration_ms", "v * 150"),
        ("DuplicateRecordDetected", "v * 0.1"),
        ("kafka_deserialization_errors_total", "v * 0.025"),
    ]
    cases = " ".join(f"when {i} then cast({x} as double)" for i, (_, x) in enumerate(shapes))
    return events(spark, sf_dir).select(
        "ts",
        pick([name for name, _ in shapes], "event_id % 11").alias("metric_name"),
        F.create_map(F.lit("environment"), F.lit("prod")).alias("dims"),
        F.expr(f"case event_id % 11 {cases} end").alias("value"),
        "event_id",
    )


def lag_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly offsets per partition."""
    e = F.col("event_id")
    lag = F.sum((F.col("v") * 100).cast("bigint")) % 60000
    return (
        events(spark, sf_dir)
        .groupBy(F.date_trunc("hour", "ts").alias("ts"), (e % 3).cast("int").alias("partition"))
        .agg(
            (F.max(F.floor(e / 3)) + 1_000_001).alias("log_end_offset"), lag.alias("_lag")
        )
        .select(
            "ts",
            F.lit(C.RAW_TOPIC).alias("topic"),
            "partition",
            (F.col("log_end_offset") - F.col("_lag")).alias("current_offset"),
            "log_end_offset",
        )
    )


def newest(df: DataFrame, ts: str) -> Column:
    """The data's own clock: its largest time, as a scalar subquery."""
    return df.agg(F.max(ts)).scalar()
