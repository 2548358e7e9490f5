"""Enrichment columns, reference joins and the JSON wire forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions import scalar as S
from orderflow.schemas import DLQ, ENRICHED_ORDER, ORDER_AGG
from orderflow.session import stage


def with_region(df: DataFrame) -> DataFrame:
    return df.withColumn("region", S.region_of(F.col("customer_id")))


def tax_rates(df: DataFrame) -> DataFrame:
    """The five fixed rates as a table."""
    rows = [(region, rate) for region, rate in C.TAX_RATES.items()]
    return df.sparkSession.createDataFrame(rows, "region string, rate_text string").select(
        "region", F.col("rate_text").cast("decimal(4,2)").alias("rate")
    )


def with_tax(df: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """``amount * rate`` to two places, ties to even.

    The fixed rates are a literal map, so no join is planned; a ``rates`` table (region, rate) is
    joined and left to the optimizer, which broadcasts it only below its size threshold.
    """
    if rates is None:
        literal = F.create_map(
            *[x for r, v in C.TAX_RATES.items() for x in (F.lit(r), F.lit(v).cast("decimal(4,2)"))]
        )
        rate, joined = literal[F.col("region")], df
    else:
        joined = df.join(rates.select("region", F.col("rate").alias("_rate")), "region", "left")
        rate = F.col("_rate").cast("decimal(4,2)")
    rate = F.coalesce(rate, F.lit(C.DEFAULT_TAX_RATE).cast("decimal(4,2)"))
    return joined.withColumn(
        "tax", F.bround(F.col("amount") * rate, 2).cast("decimal(18,2)")
    ).drop("_rate")


def with_value_category(df: DataFrame) -> DataFrame:
    return df.withColumn("order_value_category", S.value_category(F.col("amount")))


def with_merchant(df: DataFrame) -> DataFrame:
    return df.withColumn("merchant_id", S.merchant_of(F.col("customer_id"), F.col("region")))


def with_processed_at(df: DataFrame, at: Column | None = None) -> DataFrame:
    return df.withColumn("processed_at", F.current_timestamp() if at is None else at)


def with_processing_duration(df: DataFrame, slow_ms: int = 1000) -> DataFrame:
    """Milliseconds from the event to its processing, and whether that is too slow."""
    duration = F.unix_millis("processed_at") - F.unix_millis("event_time")
    return df.withColumn("processing_duration_ms", duration).withColumn(
        "is_slow", F.col("processing_duration_ms") > slow_ms
    )


def enrich_orders(df: DataFrame, at: Column | None = None) -> DataFrame:
    """All enrichment columns of a valid order."""
    enriched = with_merchant(with_value_category(with_tax(with_region(df))))
    return with_processing_duration(with_processed_at(enriched, at))


def with_reference(df: DataFrame, ref: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Add ``columns`` of a lookup table with unique ``on``, and ``error_message`` where it has no row. ``df`` may be a
    stream; each micro-batch is then joined with the table as it is at that time.

    No broadcast hint: the optimizer broadcasts ``ref`` when its measured size allows, and falls
    back to a shuffled join when the table has grown.
    """
    lookup = ref.select(on, *columns, F.lit(True).alias("_found"))
    shown = F.coalesce(F.col(on).cast("string"), F.lit("None"))
    return (
        df.join(lookup, on, "left")
        .withColumn("error_message", F.when(F.col("_found").isNull(), F.concat(F.lit(f"No reference row for {on} "), shown)))
        .drop("_found")
    )


def enrich_reference(
    df: DataFrame, ref: DataFrame, on: str, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``columns`` of the lookup table, rows for the enrichment DLQ), two views of one stored join."""
    joined = stage(with_reference(df, ref, on, columns), "looked-up")
    found, missing = F.col("error_message").isNull(), F.col("error_message").isNotNull()
    return joined.filter(found).drop("error_message"), joined.filter(missing).drop(*columns)


def with_correlation_id(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("correlation_id", S.correlation_id(*[F.col(c) for c in columns]))


_WIRE_SCHEMAS = {"enriched": ENRICHED_ORDER, "dlq": DLQ, "aggregate": ORDER_AGG}


def _wire_fields(kind: str) -> list[tuple[str, str]]:
    """(name, type) of a record kind, read off its DDL."""
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(_WIRE_SCHEMAS[kind])]


def to_wire_json(df: DataFrame, kind: str, into: str = "value") -> DataFrame:
    """Add the JSON text of each record; decimals become strings, NULL fields are kept."""
    columns = []
    for name, dtype in _wire_fields(kind):
        column = F.col(name)
        if dtype.startswith("decimal"):
            column = S.money_text(column)
        elif name.endswith("_at") or name in ("window_start", "window_end", "error_timestamp"):
            column = column if dict(df.dtypes)[name] == "string" else S.iso_text(column)
        columns.append(column.alias(name))
    return df.withColumn(into, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def from_wire_json(df: DataFrame, kind: str, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Inverse of :func:`to_wire_json`: typed columns of the record kind, after the columns to ``keep``."""
    fields = _wire_fields(kind)
    text_schema = ", ".join(
        f"`{n}` {'string' if t.startswith('decimal') else t}" for n, t in fields
    )
    parsed = df.select(*keep, F.from_json(F.col(value), text_schema).alias("r"))
    return parsed.select(*keep, *[F.col(f"r.{n}").cast(t).alias(n) for n, t in fields])


def epoch_iso(df: DataFrame, ts: str) -> DataFrame:
    """``<ts>_ms`` (epoch milliseconds) and ``<ts>_iso`` (text in UTC) beside a timestamp."""
    return df.withColumn(f"{ts}_ms", F.unix_millis(ts)).withColumn(
        f"{ts}_iso", S.iso_from_millis(F.unix_millis(ts))
    )


def items_count_check(
    orders: DataFrame, items: DataFrame, order_key: str, item_key: str, declared: str
) -> DataFrame:
    """Orders whose declared item count differs from the items that arrived."""
    counted = items.groupBy(F.col(item_key).alias(order_key)).agg(F.count("*").alias("actual_items"))
    joined = orders.join(counted, order_key, "left").withColumn(
        "actual_items", F.coalesce("actual_items", F.lit(0))
    )
    return joined.filter(F.col(declared) != F.col("actual_items"))
