"""Alarms as a stream: timers, heartbeats and the ring of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.plans.stream_queries import replay
from orderflow.session import scratch_path
from orderflow.streaming import alarms as L
from orderflow.streaming import sinks as K


def test_missing_data_changes_a_state_without_a_datapoint(spark):
    """Three datapoints, then nothing but heartbeats: periods go on closing, each alarm by its policy."""
    specs = [
        ("silent", "m", "Sum", ">", 100.0, 60, 2, 2, "breaching", "LOW"),
        ("unknown", "m", "Average", ">", 100.0, 60, 2, 1, "missing", "LOW"),
        ("calm", "m", "Maximum", ">", 5.0, 120, 1, 1, "notBreaching", "LOW"),
    ]
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s"))
    points = spark.createDataFrame([(5, 0, 3.0), (7, 1, 4.0), (70, 2, None), (80, 3, float("nan")), (130, 4, 9.5)], "s int, i bigint, value double")
    points = points.select(at.alias("ts"), F.lit("m").alias("metric_name"), "value", F.col("i").alias("event_id"))
    beats = spark.range(5, 15).select(F.timestamp_seconds(F.lit(1_704_067_200 - 300) + F.col("id") * 90).alias("timestamp"), "id")
    rows = points.unionByName(L.with_heartbeat(points, beats).filter("metric_name = ''").withColumn("event_id", F.unix_seconds("ts") - 1_704_067_000))
    out = scratch_path(spark, "alarms")
    replay(rows, lambda s, ck: K.write_table(L.evaluate_alarms_stream(s, specs, "10 seconds"), out, ck, None), n=4, order="event_id")
    got = {}
    for r in spark.read.parquet(out).orderBy("period_start").collect():
        got.setdefault(r.alarm_name, []).append((r.value, r.state, r.from_state, r.held_s))
    closed = (15 - 1) * 90 - 300 - 10  # seconds the last watermark has passed
    assert {name: len(states) for name, states in got.items()} == {"silent": closed // 60, "unknown": closed // 60, "calm": closed // 120}
    assert got["silent"][:4] == [(7.0, "OK", "OK", 0), (None, "OK", "OK", 60), (9.5, "OK", "OK", 120), (None, "OK", "OK", 180)]
    assert got["silent"][4][1:] == ("ALARM", "OK", 240) and got["silent"][-1][1:3] == ("ALARM", "ALARM")
    assert [s[1] for s in got["unknown"][:5]] == ["OK", "OK", "OK", "OK", "INSUFFICIENT_DATA"]
    assert [s[:2] for s in got["calm"][:3]] == [(4.0, "OK"), (9.5, "ALARM"), (None, "OK")]
