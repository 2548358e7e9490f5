"""The sliced, salted and two-level paths against brute force, with one key holding half the rows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from orderflow.functions.percentiles import exact_percentiles
from orderflow.functions.running import running
from orderflow.operators import dedup as D
from orderflow.operators import features as X
from orderflow.operators import late as L
from orderflow.operators import latency as Y
from orderflow.operators import quality as Q
from orderflow.operators import windows as W


def skewed(n, seed, span):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", rng.randrange(span), rng.randrange(100))
        for _ in range(n)
    ]


def test_running_matches_brute_force(spark):
    rows = [(k, t - 500, v) for k, t, v in skewed(400, 1, 1000)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    for keys in (["k"], []):
        for include in (False, True):
            got = running(
                df, keys, "t", 7, {"s": ("sum", "v"), "m": ("max", "v")}, include_current=include,
                fan=4,
            ).collect()
            assert len(got) == len(rows)
            for r in got:
                seen = [
                    v for k, t, v in rows
                    if (not keys or k == r["k"]) and (t <= r["t"] if include else t < r["t"])
                ]
                assert r["s"] == sum(seen)
                assert r["m"] == (max(seen) if seen else None)


def test_running_over_ranges_of_rows(spark):
    """Slices by rows: one hot key and one hot point in time, null keys, and ties that order peers."""
    rng = random.Random(11)
    rows = [
        (rng.choice(["hot", "hot", "a", None]), 7 if rng.random() < 0.5 else rng.randrange(50), i, rng.randrange(9))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "k string, t bigint, n bigint, v bigint").repartition(5)
    for keys in (["k"], []):
        for ties in ((), ("n",)):
            got = running(df, keys, "t", None, {"s": ("sum", "v")}, ties=ties).collect()
            assert len(got) == len(rows)
            for r in got:
                seen = [
                    v for k, t, n, v in rows
                    if (not keys or k == r["k"]) and ((t, n) < (r["t"], r["n"]) if ties else t < r["t"])
                ]
                assert r["s"] == sum(seen)


def test_hot_range_is_split(spark):
    """Half of all rows in one minute do not make one slice."""
    from orderflow.session import stage

    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("minute"), "id")
    dealt = stage(df.repartitionByRange(8, "minute", "id").withColumn("_slice", F.spark_partition_id()), "hot")
    assert max(r["count"] for r in dealt.groupBy("_slice").count().collect()) < 5000


def test_percentiles_match_numpy(spark):
    rows = skewed(700, 2, 100000)
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    probabilities = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    for keys in ([], ["k"]):
        for r in exact_percentiles(df, keys, "t", probabilities, width=64).collect():
            values = [t for k, t, _ in rows if not keys or k == r["k"]]
            assert r["n"] == len(values)
            for name, p in probabilities.items():
                assert abs(r[name] - np.quantile(values, p)) < 1e-6


def test_percentiles_of_fractions_and_null_keys(spark):
    rows = [(None, 0.25), (None, 0.5), (None, 0.75), ("a", 1.5), ("a", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: (r["n"], r["p50"]) for r in exact_percentiles(df, ["k"], "x", {"p50": 0.5}).collect()}
    assert got == {None: (3, 0.5), "a": (1, 1.5)}


def test_null_operator_is_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("x", 5)], "operator string, latency_ms int")
    assert {r["operator"]: r["max_latency"] for r in Y.latency_by_operator(df).collect()} == {None: 3, "x": 5}


def chain(arrivals, ttl):
    accepted, last = set(), None
    for at in sorted(arrivals):
        if last is None or at[0] >= last + ttl:
            accepted.add(at)
            last = at[0]
    return accepted


def test_dedup_chain_matches_brute_force(spark):
    rows = [(k, t, i) for i, (k, t, _) in enumerate(skewed(600, 3, 4000))]
    df = spark.createDataFrame(rows, "order_id string, sec bigint, arrival_seq bigint").withColumn(
        "arrival_ts", F.timestamp_seconds("sec")
    )
    for ttl in (300, 1_000_000):
        flagged = D.flag_duplicates(df, ttl_seconds=ttl).collect()
        assert len(flagged) == len(rows)
        for key in {k for k, _, _ in rows}:
            want = chain([(t, i) for k, t, i in rows if k == key], ttl)
            got = {
                (r["sec"], r["arrival_seq"]) for r in flagged if r["order_id"] == key and not r["is_dup"]
            }
            assert got == want


def test_dedup_orders_by_partition_and_offset(spark):
    """Records of one millisecond: offsets 0 and 4, offsets 7 and 8, two partitions, and a record read twice."""
    raw = [("a", 0, 0), ("a", 0, 4), ("b", 0, 7), ("b", 0, 8), ("c", 1, 0), ("c", 0, 9), ("d", 2, 5), ("d", 2, 5), (None, 0, 1), (None, 0, 2)]
    df = spark.createDataFrame(raw, "order_id string, partition int, offset bigint").select(
        "order_id", F.timestamp_seconds(F.lit(1)).alias("arrival_ts"), F.struct("partition", "offset").alias("arrival_seq")
    )
    rows = D.flag_duplicates(df).collect()
    kept = sorted((r["order_id"] or "", r["arrival_seq"]["partition"], r["arrival_seq"]["offset"]) for r in rows if not r["is_dup"])
    assert kept == [("", 0, 1), ("a", 0, 0), ("b", 0, 7), ("c", 0, 9), ("d", 2, 5)]
    assert len(rows) == len(raw)


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame(
        [("a", 0, 1), ("a", 10, 2), ("b", 5, 3)], "order_id string, sec bigint, arrival_seq bigint"
    ).withColumn("arrival_ts", F.timestamp_seconds("sec"))
    once = D.dedup_first(df)
    assert sorted(D.dedup_first(once).collect()) == sorted(once.collect())


def test_point_in_time_matches_brute_force(spark):
    features = [(k, t, i) for i, (k, t, _) in enumerate(skewed(300, 4, 5000))]
    labels = [(k, t, i) for i, (k, t, _) in enumerate(skewed(200, 5, 5000))] + [("none", 3, 999)]
    f = spark.createDataFrame(features, "k string, sec bigint, fid bigint").withColumn(
        "ft", F.timestamp_seconds("sec")
    )
    lab = spark.createDataFrame(labels, "k string, sec bigint, lid bigint").withColumn(
        "lt", F.timestamp_seconds("sec")
    )
    for width in (60_000_000, None):
        got = X.point_in_time(lab, f, "k", "lt", "ft", ["fid"], tie="fid", width_us=width).collect()
        assert len(got) == len(labels)
        for r in got:
            known = [(t, i) for k, t, i in features if k == r["k"] and t <= r["sec"]]
            assert r["fid"] == (max(known)[1] if known else None)


def test_customer_history_matches_brute_force(spark):
    rows = [(k, t, v) for k, t, v in skewed(300, 6, 3000)]
    df = spark.createDataFrame(rows, "c string, sec bigint, amount bigint").withColumn(
        "t", F.timestamp_seconds("sec")
    )
    spans = {"short": 50, "long": 1000}
    got = X.customer_history(df, "c", "t", "amount", spans, width_us=70_000_000).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [(t, v) for k, t, v in rows if k == r["c"] and t < r["sec"]]
        for name, span in spans.items():
            inside = [v for t, v in mine if t >= r["sec"] - span]
            assert (r[f"orders_{name}"], r[f"amount_{name}"]) == (len(inside), sum(inside))
        assert r["recency_s"] == (r["sec"] - max(t for t, _ in mine) if mine else None)


def test_late_flag_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, 10_000 + i * 20 - rng.choice([0, 0, 0, 900, 2000])) for i in range(300)]
    df = spark.createDataFrame(rows, "arrival_seq bigint, sec bigint").withColumn(
        "event_time", F.timestamp_seconds("sec")
    ).withColumn("arrival_ts", F.timestamp_seconds(F.floor(F.col("arrival_seq") / 7)))
    got = {r["arrival_seq"]: r["is_late"] for r in L.flag_late(df).collect()}
    seen = None
    for seq, sec in rows:
        end = sec // 300 * 300 + 300
        assert got[seq] == (seen is not None and end + 600 <= seen)
        seen = sec if seen is None else max(seen, sec)
    assert any(got.values())


def test_sessions_match_the_built_in_window(spark):
    rows = [(k, t, v) for k, t, v in skewed(300, 8, 20000)]
    df = spark.createDataFrame(rows, "k string, sec bigint, v bigint").select(
        "k", F.timestamp_seconds("sec").alias("event_time"),
        F.col("v").cast("decimal(24,6)").alias("amount"),
    )
    ours = W.sessions(df, "k", 60).drop("max_order_value")
    built_in = W.sessions_stream(df, "k", "60 seconds")
    columns = ["k", "session_start", "session_end", "total_orders"]
    assert ours.select(columns).exceptAll(built_in.select(columns)).isEmpty()
    assert built_in.select(columns).exceptAll(ours.select(columns)).isEmpty()


def test_missing_bins(spark):
    df = spark.createDataFrame([(0,), (61,), (86400 * 3,)], "s bigint").select(
        F.timestamp_seconds("s").alias("ts")
    )
    got = {r["m"] for r in Q.missing_bins(df, "ts", 3600, "m").select(F.unix_seconds("m").alias("m")).collect()}
    assert got == set(range(3600, 86400 * 3, 3600))
