"""As-of lookups in a laid-out history against brute force, and what their plans shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.session import scratch_path
from orderflow.sources import laid_out as Z

FEATURES = "k string, s bigint, i bigint, v double, note string"
LABELS = "k string, s bigint, n bigint"


def _at(rows, spark, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))


def brute(features, labels):
    out = {}
    for k, s, n in labels:
        mine = [f for f in features if f[0] == k and f[1] is not None and s is not None and f[1] <= s]
        best = max(mine, key=lambda f: (f[1], f[2]), default=None)
        out[n] = None if best is None else (best[1], best[3], best[4])
    return out


def test_lookup_equals_brute_force_and_reads_blocks_in_place(spark):
    features = [("hot", 7200 + (i * 37) % 20_000, i, float(i), f"f{i}") for i in range(2000)]
    features += [("hot", 9000, 5000 + i, None, "tie") for i in range(40)]  # ties over several blocks
    features += [("rare", 10, 1, 1.0, None), ("rare", 90_000, 2, 2.0, "x"), (None, 50, 3, 3.0, "null key"), ("", 60, 4, 4.0, "empty"), ("rare", None, 5, 5.0, "timeless")]
    labels = [("hot", 7000 + i * 41, i) for i in range(600)]
    labels += [("rare", 9, 600), ("rare", 10, 601), ("rare", 50_000, 602), ("rare", 10**6, 603), (None, 49, 604), (None, 51, 605), ("", 60, 606), ("new", 60, 607), ("hot", None, 608), ("hot", 9000, 609), ("hot", 9000, 609)]
    history = Z.lay_out(_at(features, spark, FEATURES), scratch_path(spark, "history"), "k", "ts", ["v", "note"], "i", 4, block_rows=16)
    assert history.blocks.agg(F.max(F.size("_features"))).first()[0] == 16
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = Z.lookup_as_of(_at(labels, spark, LABELS), history, "k", "ts")
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.select("n", F.unix_seconds("feature_time").alias("at"), "v", "note").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == len(labels)
    assert {r.n: None if r.at is None else (r.at, r.v, r.note) for r in rows} == brute(features, labels)
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 1 and plan.count("Exchange") == 1  # that of the labels
    assert "Bucketed: true" in plan


def test_empty_sides(spark):
    empty = _at([], spark, FEATURES)
    history = Z.lay_out(empty, scratch_path(spark, "history"), "k", "ts", ["v"], "i", 2)
    assert [tuple(r) for r in Z.lookup_as_of(_at([("a", 1, 1)], spark, LABELS), history, "k", "ts").select("n", "v").collect()] == [(1, None)]
    assert Z.lookup_as_of(_at([], spark, LABELS), history, "k", "ts").collect() == []
