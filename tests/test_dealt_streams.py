"""Micro-batches of replayed streams have rows in many files, however the input is laid out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderflow.plans import stream_queries as Z
from orderflow.plans.catalog import QUERIES
from orderflow.session import scratch_path

ROWS = 1_500


@pytest.mark.parametrize("name", ["K2_write_dlq", "F6_tiled_history_stream"])
def test_first_micro_batch_is_dealt(spark, monkeypatch, name):
    """One file in the order of time: its first third is one range of rows, and was one task of the first micro-batch."""
    folder, files = scratch_path(spark, "sf"), []
    rows = spark.range(0, ROWS, 1, 1).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).alias("ts"), (F.col("id") % 40).alias("user_id"),
        F.lit("purchase").alias("event_type"), (F.col("id") % 90 + 1).cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    read = Z.read_orders_stream

    def recorded(session, source):
        files.append(session.read.parquet(source["files"]).select(F.input_file_name()).distinct().count())
        return read(session, source)

    monkeypatch.setattr(Z, "read_orders_stream", recorded)
    assert QUERIES[name](spark, folder).count() > 0
    assert len(files) == 3 and files[0] > 1
