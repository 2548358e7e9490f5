"""Lakes of small files: their number follows the hours, not the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.plans import window_queries as Q
from orderflow.plans.catalog import QUERIES
from orderflow.session import scratch_path
from orderflow.sources import lake as K
from orderflow.sources.snapshots import SnapshotLake

ROWS = 6_000


def table_of(spark):
    """Two hours of events in a table of their own, most of them in the first."""
    folder = scratch_path(spark, "sf")
    second = F.when(F.col("id") % 10 == 0, 3600).otherwise(0) + F.col("id") % 3600
    rows = spark.range(ROWS).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + second).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


def test_small_files_of_an_hour_do_not_grow_with_its_rows(spark, monkeypatch):
    written = []
    write = K.write_lake

    def recorded(df, path, *args, **kwargs):
        write(df, path, *args, **kwargs)
        per_hour = K.partitions_of_files(K.lake_files(spark, path)).agg(F.max("files")).first()[0]
        written.append(per_hour)

    monkeypatch.setattr(K, "write_lake", recorded)
    monkeypatch.setattr("orderflow.sources.snapshots.write_lake", recorded)
    sf = table_of(spark)
    found = QUERIES["K9_compact_partitions"](spark, sf).collect()
    assert {(r["files"], r["rows"]) for r in found} <= {(1, n) for n in range(ROWS)} and sum(r["rows"] for r in found) == ROWS
    assert all(r["files"] == 1 for r in QUERIES["K9_snapshot_files"](spark, sf).collect())
    rows = QUERIES["K9_snapshots"](spark, sf).filter("moment = 'after'").collect()
    assert sum(r["rows"] for r in rows) == ROWS
    # Several files an hour are there to compact, and about as many as flushes.
    assert 1 < written[0] <= 2 * K.FLUSHES_AN_HOUR and max(written) <= 2 * K.FLUSHES_AN_HOUR


def test_flush_rows(spark):
    rows = spark.range(1_000).withColumn("ts", F.timestamp_seconds(F.col("id")))
    assert Q._flush_rows(rows, 8) == 84 and Q._flush_rows(rows.limit(5), 8) == 8 and Q._flush_rows(rows.limit(0), 8) == 8
    lake = SnapshotLake(spark, scratch_path(spark, "lake"), "ts")
    lake.append(rows, rows_per_file=84)
    assert 1 < lake.files().count() <= 2 * K.FLUSHES_AN_HOUR
