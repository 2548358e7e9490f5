"""Replays by an index of files: the rows of the range, and only its files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orderflow.session import scratch_path
from orderflow.sources import indexed as X

SCHEMA = "o bigint, t timestamp, value string"
START = datetime(2024, 1, 1)


def test_replay_opens_only_files_of_its_range(spark):
    root = scratch_path(spark, "log")
    write = X.indexed_log(root, "o", "t", rows_a_file=100)
    assert X.files_of(spark, root) == [] and X.replay_indexed(spark, root, SCHEMA, "o", "t").count() == 0
    for n in range(4):
        rows = [(n * 1000 + i, START + timedelta(seconds=n * 1000 + i), f"v{i}") for i in range(1000)]
        for _ in range(2 if n == 2 else 1):  # a repeated micro-batch leaves one copy
            write(spark.createDataFrame(rows, SCHEMA).repartition(3), n)
    write(spark.createDataFrame([], SCHEMA), 4)
    all_files = X.files_of(spark, root)
    assert X.read_index(spark, root).agg(F.sum("n")).first()[0] == 4000 and 36 <= len(all_files) <= 40

    def offsets(**bounds):
        return sorted(r.o for r in X.replay_indexed(spark, root, SCHEMA, "o", "t", **bounds).collect())

    assert offsets(offsets=(950, 1050)) == list(range(950, 1050))
    assert len(X.files_of(spark, root, offsets=(950, 1050))) <= 4
    late = START + timedelta(seconds=3900)
    assert offsets(times=(late, None)) == list(range(3900, 4000))
    assert len(X.files_of(spark, root, times=(late, None))) <= 3
    assert offsets(offsets=(None, 3905), times=(late, None)) == list(range(3900, 3905))
    assert offsets(offsets=(9000, None)) == [] and len(offsets()) == 4000


def test_rows_without_offset_or_time_are_in_unbounded_replays(spark):
    root = scratch_path(spark, "log")
    rows = [(1, START, "a"), (None, START, "b"), (2, None, "c"), (None, None, "d"), (2, START, "e")]
    X.indexed_log(root, "o", "t", rows_a_file=2)(spark.createDataFrame(rows, SCHEMA), 0)

    def values(**bounds):
        return sorted(r.value for r in X.replay_indexed(spark, root, SCHEMA, "o", "t", **bounds).collect())

    assert values() == list("abcde")
    assert values(offsets=(2, None)) == ["c", "e"]
    assert values(times=(START, None)) == ["a", "b", "e"]
