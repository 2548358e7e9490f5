"""Mergeable profiles: odd values, uniting in any order, and the stated error on many rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.operators import distincts as T

COLUMNS = ["a", "b", "odd name"]


def _profiles(rollups):
    return {r.column_name: (r.row_count, r.null_count, r.distinct_estimate, r.is_constant) for r in T.profiles(T.united(rollups)).collect()}


def test_hours_unite_like_raw_rows(spark):
    rows = [(i * 600, f"v{i % 7}", None, "") for i in range(50)] + [(100, "", None, ""), (None, "v1", None, "")]
    df = spark.createDataFrame(rows, "sec bigint, a string, b double, `odd name` string").withColumn("ts", F.timestamp_seconds("sec"))
    whole = {"a": (52, 0, 8, False), "b": (52, 52, 0, True), "odd name": (52, 0, 1, True)}
    hours = T.distinct_rollup(df, "ts", COLUMNS)
    assert _profiles(hours) == whole
    assert _profiles(T.united(hours, "day")) == whole
    # A range, and hours that two micro-batches share.
    first = _profiles(hours.filter(F.col("start") < F.timestamp_seconds(F.lit(3600))))
    assert first["a"] == (7, 0, 7, False)
    halves = T.distinct_rollup(df.filter("a < 'v3'"), "ts", COLUMNS).unionByName(T.distinct_rollup(df.filter("a >= 'v3'"), "ts", COLUMNS))
    assert _profiles(halves) == whole


def test_error_is_as_stated_on_many_rows(spark):
    df = spark.range(400_000).select(
        F.timestamp_seconds(F.col("id") % 90_000).alias("ts"), F.col("id").alias("a"), (F.col("id") % 5_000).cast("string").alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).alias("odd name"),
    )
    hours = T.distinct_rollup(df, "ts", COLUMNS)
    checked = T.distincts_checked(T.profiles(T.united(T.united(hours, "day"))), df, COLUMNS).collect()
    assert len(checked) == 3 and all(r.distinct_near for r in checked)
    assert {r.column_name: r.distinct_count for r in checked} == {"a": 400_000, "b": 5_000, "odd name": 1}
    assert max(hours.select(F.length("sketch")).collect())[0] < 5_000


def test_empty(spark):
    df = spark.createDataFrame([], "ts timestamp, a string")
    assert T.profiles(T.united(T.distinct_rollup(df, "ts", ["a"]), "day")).collect() == []
