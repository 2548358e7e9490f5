"""Versions of the lake: failed runs, repeated micro-batches, writers that meet, old versions."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orderflow.plans import inputs as I
from orderflow.plans import stream_queries as Z
from orderflow.session import child_names, publish_text, read_text, scratch_path
from orderflow.sources.snapshots import FULL, Conflict, SnapshotLake
from orderflow.streaming import sinks as K

SF = "/root/testdata/sf0.001"


@pytest.fixture
def lake(spark):
    return SnapshotLake(spark, scratch_path(spark, "snapshots"), "ts")


def rows_at(spark, first, n, hour=6):
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(3600 * hour) + F.col("id") * 7)
    return spark.range(first, first + n).withColumn("ts", stamp)


def ids(rows):
    return sorted(r.id for r in rows.select("id").collect())


def test_text_is_published_once(spark):
    path = scratch_path(spark, "texts") + "/000000001"
    assert publish_text(spark, path, "one") and not publish_text(spark, path, "two")
    assert read_text(spark, path) == "one"
    assert [n for n in child_names(spark, path.rpartition("/")[0]) if not n.startswith(".")] == ["000000001"]


def test_unfinished_and_failed_compaction_is_invisible(spark, lake):
    lake.append(rows_at(spark, 0, 100), rows_per_file=10)
    before = lake.files().count()

    def die():
        assert ids(lake.read()) == list(range(100))
        raise OSError("the driver is lost")

    with pytest.raises(OSError):
        lake.compact(while_running=die)
    assert lake.versions() == [1] and lake.files().count() == before
    assert lake.compact() == 2 and lake.files().count() < before
    assert ids(lake.read()) == ids(lake.read(version=1)) == list(range(100))
    # What the failed run left goes; what a version lists stays.
    assert lake.vacuum(keep=2) == 1 and ids(lake.read(version=1)) == list(range(100))
    assert lake.vacuum(keep=1) == 1 and ids(lake.read()) == list(range(100))
    assert lake.compact() == 2


def test_two_compactions_and_an_append_meet(spark, lake):
    lake.append(rows_at(spark, 0, 60), rows_per_file=10)

    def other():
        lake.append(rows_at(spark, 60, 5))
        lake.compact()

    with pytest.raises(Conflict):
        lake.compact(while_running=other)
    assert ids(lake.read()) == list(range(65)) and lake.versions() == [1, 2, 3]


def test_repeated_micro_batch_is_committed_once(spark, lake):
    write = lake.appending("orders")
    for batch_id in (0, 1, 1, 2):
        write(rows_at(spark, 10 * batch_id, 10), batch_id)
    lake.compact()
    write(rows_at(spark, 20, 10), 2)
    assert ids(lake.read()) == list(range(30))


def test_many_versions_and_pruned_reads(spark, lake):
    for n in range(FULL + 3):
        lake.append(rows_at(spark, 10 * n, 10, hour=n))
    everything = list(range(10 * (FULL + 3)))
    assert ids(lake.read()) == everything
    assert ids(lake.read(version=FULL)) == everything[: 10 * FULL]
    start = datetime.fromtimestamp(1_700_000_000 + 3600 * 4)
    part = lake.read(start, datetime.fromtimestamp(1_700_000_000 + 3600 * 6))
    assert ids(part) == list(range(40, 60)) and len(part.inputFiles()) <= 4
    with pytest.raises(ValueError):
        SnapshotLake(spark, scratch_path(spark, "none"), "ts").read()


def test_stream_goes_on_during_compaction(spark, lake):
    """Four micro-batches of a streaming query with a compaction after each; every row is there once."""
    events = I.staged(I.events(spark, SF), "events")

    def start(stream, checkpoint):
        query = K.write_each(stream, lake.appending("events", rows_per_file=5), checkpoint, None)
        query.awaitTermination()
        lake.compact()
        return query

    Z.replay(events, start, n=4, order="event_id")
    assert lake.read().count() == events.count() == lake.read().select("event_id").distinct().count()
    assert lake.files().groupBy("day", "hour").count().filter("count > 1").isEmpty()
