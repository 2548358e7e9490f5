"""Literal cases of the order contract."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderflow.functions import scalar as S
from orderflow.operators import enrich as E
from orderflow.operators import errors as O
from orderflow.operators import lag as G
from orderflow.operators import quality as Q
from orderflow.operators import validate as V
from orderflow.operators import windows as W
from orderflow.sources.orders import explode_captured_batch

GOOD = {
    "order_id": "ORD-1", "customer_id": "CUST-US-001", "amount": "149.99", "currency": "USD",
    "status": "confirmed", "timestamp": "2025-01-13T15:30:45.123Z", "items_count": 3,
}


def judge(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    rows = V.validate_orders(df).orderBy("i").collect()
    return [(r["error_type"], r["error_message"]) for r in rows]


def order(**changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v != "-drop-"})


def test_schema_errors(spark):
    texts = [
        order(), "{", "", "null", "[]", "3", order() + "}", order() + " x", order() + "," + order(),
        order() + "]", order() + "],[" + order(), order() + "},{" + order(),
        order(status="-drop-"), order(extra=1), order(amount="abc"), order(amount=None),
        order(amount="NaN"), order(items_count="x"), order(customer_id=None), order(timestamp=123),
        order(timestamp=None),
    ]
    got = judge(spark, *texts)
    assert got[0] == (None, None)
    assert judge(spark, order(customer_id="CUST-US-]"))[0] == (None, None)
    assert {t for t, _ in got[1:]} == {"SCHEMA_INVALID"}
    assert [m.split(":")[0] for _, m in got[1:]] == (
        ["Invalid JSON"] * 2 + ["Unexpected error"] * 3 + ["Invalid JSON"] * 6
        + ["Unexpected error"] * 9
    )


@pytest.mark.parametrize(
    "changes, message",
    [
        ({"amount": "0.0099999"}, "Amount must be >= 0.01"),
        ({"amount": "-5"}, "Amount must be >= 0.01"),
        ({"amount": "-Infinity"}, "Amount must be >= 0.01"),
        ({"amount": "1000000"}, "Amount must be <= 999999.99"),
        ({"amount": "Infinity"}, "Amount must be <= 999999.99"),
        ({"amount": "1e30"}, "Amount must be <= 999999.99"),
        ({"currency": "ZZZ"}, "Currency 'ZZZ' not supported"),
        ({"timestamp": "2025"}, "Timestamp '2025' not valid ISO-8601"),
        ({"timestamp": "2025-13-01"}, "Timestamp '2025-13-01' not valid ISO-8601"),
        (
            {"amount": "0", "currency": "X"},
            "Amount must be >= 0.01; Currency 'X' not supported",
        ),
    ],
)
def test_business_rules(spark, changes, message):
    assert judge(spark, order(**changes)) == [("BUSINESS_RULE_VIOLATION", message)]


def test_accepted_times(spark):
    times = {
        "2025-01-13": "2025-01-13 00:00:00", "20250113": "2025-01-13 00:00:00",
        "2025-W03-1": "2025-01-13 00:00:00", "2025-01-13T15:30:45.123+05:30": "2025-01-13 10:00:45.123",
        "2025-01-13 15:30": "2025-01-13 15:30:00", "2025-01-13T15:30:45,5Z": "2025-01-13 15:30:45.5",
    }
    df = spark.createDataFrame([(k, v) for k, v in times.items()], "text string, want string")
    bad = df.filter(
        ~S.iso_timestamp(F.col("text")).eqNullSafe(F.col("want").cast("timestamp"))
    )
    assert bad.collect() == []


def test_enrichment(spark):
    rows = [
        ("CUST-US-001", "149.99", "us", "12.00", "medium", "MERCH-US-022"),
        ("CUST-789456", "49.99", "ca", "2.50", "small", None),
        ("X", "50", "ca", "2.50", "medium", None),
        ("CUST-eu-1", "500", "eu", "95.00", "medium", None),
        ("CUST-UK-1", "500.01", "uk", "100.00", "large", None),
        ("CUST-CA-1", "2.50", "ca", "0.12", "small", None),
    ]
    df = spark.createDataFrame(
        rows, "customer_id string, a string, w_region string, w_tax string, w_cat string, w_m string"
    ).withColumn("amount", F.col("a").cast("decimal(24,6)"))
    df = df.withColumn("event_time", F.current_timestamp())
    for r in E.enrich_orders(df).collect():
        assert (r["region"], r["tax"], r["order_value_category"]) == (
            r["w_region"], Decimal(r["w_tax"]), r["w_cat"],
        )
        assert r["w_m"] is None or r["merchant_id"] == r["w_m"]


def test_average_is_half_even(spark):
    rows = [("724.95", 5, "144.99"), ("0.01", 2, "0.00"), ("0.03", 2, "0.02"), ("0.05", 2, "0.02"),
            ("1", 3, "0.33"), ("-0.05", 2, "-0.02"), ("0.015000", 1, "0.02"), ("0.025", 1, "0.02")]
    df = spark.createDataFrame(rows, "t string, n bigint, want string")
    got = df.select(
        "want", S.half_even_average(F.col("t").cast("decimal(38,6)"), F.col("n")).alias("g")
    ).collect()
    assert [r["g"] for r in got] == [Decimal(r["want"]) for r in got]


def test_wire_round_trip(spark):
    df = spark.createDataFrame([(order(amount="149.999"), 1)], "value string, arrival_seq bigint")
    at = F.lit("2025-01-13 15:30:46.234").cast("timestamp")
    first = E.to_wire_json(E.enrich_orders(V.validate_orders(df), at), "enriched", into="wire")
    back = E.from_wire_json(first, "enriched", "wire")
    again = E.to_wire_json(back, "enriched", into="wire").select("wire").collect()
    assert again == first.select("wire").collect()
    record = json.loads(again[0]["wire"])
    assert record["amount"] == "149.999" and record["items_count"] == 3
    assert record["processing_duration_ms"] == 1111


def test_renamed_field(spark):
    texts = [
        '{"order_id":"1","customer_id":"CUST-123"}', '{"order_id":"1","cust_id":"CUST-123"}',
        '{"order_id":"1","cust_id":"CUST-123","customer_id":"old"}',
        '{"order_id":"1","cust_id":"","customer_id":"CUST-123"}', "{oops",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    fixed = [r["value"] for r in V.parse_tolerant(df, {"customer_id": ["cust_id"]}).collect()]
    assert [json.loads(t)["customer_id"] for t in fixed[:4]] == ["CUST-123"] * 4
    assert fixed[4] == "{oops"


def test_bad_tick(spark):
    df = spark.createDataFrame([("XYZ", "N/A", "123")], "ticker string, price string, datetime string")
    assert len(V.validate_ticks(df, ["AAPL"], "2020-01-01").first()["errors"]) == 3


def test_lag_and_gap_and_share(spark):
    snaps = spark.createDataFrame(
        [(0, "t", 0, 50000, 75000), (0, "t", 1, 40000, 95000), (0, "t", 2, 45000, 60000)],
        "ts int, topic string, partition int, current_offset bigint, log_end_offset bigint",
    )
    lag = G.consumer_lag(snaps).first()
    assert (lag["total_lag"], lag["max_lag"], lag["slowest_partition"]) == (95000, 55000, 1)
    stats = spark.createDataFrame(
        [(10000, 9200, 500)], "records_in int, records_out int, records_late int"
    )
    assert Q.unaccounted(stats).first()["unaccounted"] == 300
    names = {"parse_error": 80, "duplicate": 15, "validation_error": 5}
    errors = spark.createDataFrame([(n,) for n, k in names.items() for _ in range(k)], "error_type string")
    assert {r["error_type"]: r["percent"] for r in O.error_share(errors).collect()} == names


def test_undecodable_records_are_skipped(spark):
    texts = ['{"records":{"t-0":[{"value":"%%"},{"value":"e30="},{"other":1}]}}', "not json", "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert [r["payload"] for r in explode_captured_batch(df).collect()] == ["{}", "{}"]


def test_accumulators_merge_in_any_order(spark):
    rows = [("us", f"2025-01-13 15:2{i % 10}:00", str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "region string, t string, a string").select(
        "region", F.col("t").cast("timestamp").alias("event_time"),
        F.col("a").cast("decimal(24,6)").alias("amount"), F.pmod(F.hash("a"), F.lit(5)).alias("part"),
    )
    whole = W.window_accumulate(df, ["region"])
    merged = W.merge_accumulators(W.window_accumulate(df, ["region", "part"]), ["region"])
    assert whole.exceptAll(merged.select(whole.columns)).isEmpty()
