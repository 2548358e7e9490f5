"""Quantile rollups: odd values, merging in any order, and the stated error on many rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orderflow.operators import rollups as R


def test_minutes_merge_like_raw_points(spark):
    rows = [("m", 60 * (i % 5), float(i)) for i in range(100)] + [("m", 0, None), ("m", 0, float("nan")), (None, 0, 7.0)]
    points = spark.createDataFrame(rows, "k string, sec bigint, v double").withColumn("ts", F.timestamp_seconds("sec"))
    minutes = R.rollup(points, ["k"], "ts", "v")
    assert minutes.filter("k = 'm'").count() == 5
    # A minute in several rows, as micro-batches leave it.
    halves = R.rollup(points.filter("v < 50"), ["k"], "ts", "v").unionByName(R.rollup(points.filter("v >= 50"), ["k"], "ts", "v"))
    for source in (minutes, halves):
        day = {r.k: r for r in R.with_quantiles(R.coarser(source, ["k"], "day")).collect()}
        assert (day["m"].n, day["m"].total, day["m"].low, day["m"].high) == (100, 4950.0, 0.0, 99.0)
        assert (day["m"].p50, day["m"].p95, day["m"].p99) == (49.0, 94.0, 98.0)
        assert (day[None].n, day[None].p50) == (1, 7.0)


def test_error_is_as_stated_on_many_rows(spark):
    """300,000 skewed values in 600 minutes, one key with nearly all of them."""
    points = spark.range(300_000).select(
        F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("k"),
        F.timestamp_seconds(F.col("id") % 36_000).alias("ts"),
        F.exp(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 1000.0).alias("v"),
    )
    rolled = R.rollup(points, ["k"], "ts", "v")
    for unit in ("hour", "day", None):
        rolled = R.coarser(rolled, ["k"], unit)
    for r in R.rank_checked(rolled, points, ["k"], "v").collect():
        assert r.p50_near and r.p95_near and r.p99_near
    assert max(rolled.select(F.length("sketch")).collect())[0] < 40_000
    assert math.isclose(R.rank_error(400), 0.0103, abs_tol=0.001)


def test_empty(spark):
    points = spark.createDataFrame([], "k string, ts timestamp, v double")
    assert R.with_quantiles(R.coarser(R.rollup(points, ["k"], "ts", "v"), ["k"], "hour")).collect() == []
