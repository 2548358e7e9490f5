"""Histories from time tiles against brute force, over repeated, late and odd micro-batches."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderflow.session import child_names, scratch_path
from orderflow.streaming import histories as H

SPANS = {"2m": 120, "3h": 3 * 3600}
SCHEMA = "i bigint, k string, us bigint, v decimal(18,2)"


def brute(batches):
    seen, out = [], {}
    for rows in batches:
        seen += [r for r in rows if r[2] is not None]
        for i, k, us, _ in rows:
            if us is None:
                out[i] = (None,) * 5
                continue
            mine = [(u, v or 0) for _, key, u, v in seen if key == k and u < us]
            within = [[(u, v) for u, v in mine if us - s * 1_000_000 <= u] for s in SPANS.values()]
            last = max((u for u, _ in mine), default=None)
            out[i] = (*[x for w in within for x in (len(w), sum(v for _, v in w))], None if last is None else (us - last) // 1_000_000)
    return out


def test_histories_equal_brute_force(spark, monkeypatch):
    """Five micro-batches of an hour and a half, on both sides of midnight: a hot key, ties, rows on the edges of minutes, late and odd rows, one repeated."""
    start = 1_704_153_600 - 4 * 3600
    batches, i = [], 0
    for b in range(5):
        rows = []
        for j in range(60):
            at = (start + b * 5400 + j * 90 + (j * j) % 7) * 1_000_000 + (j % 3) * 500_000
            key = None if j % 20 == 3 else "hot" if j % 3 else f"k{j % 4}"
            rows.append((i, key, at, None if j % 11 == 5 else Decimal(j) / 4))
            i += 1
        rows.append((i, "hot", (start + b * 5400 + 600) * 1_000_000, Decimal(1)))
        rows.append((i + 1, "hot", (start + b * 5400 + 600) * 1_000_000, Decimal(1)))
        rows.append((i + 2, "hot", (start + b * 5400 - 1800) * 1_000_000 if b else None, Decimal(2)))  # late by half an hour
        batches.append(rows)
        i += 3
    opened = []
    read = H.TiledHistory.read

    def counted(self, level, units, upto):
        opened.append((upto, level, len(units)))
        return read(self, level, units, upto)

    monkeypatch.setattr(H.TiledHistory, "read", counted)
    root = scratch_path(spark, "histories")
    write = H.history_batches(root, "k", "ts", "v", SPANS, fan=2)
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
        for _ in range(2 if n == 3 else 1):
            write(frame, n)
    got = {r.i: (r.orders_2m, r.amount_2m, r.orders_3h, r.amount_3h, r.recency_s) for r in H.read_histories(spark, root).collect()}
    assert got == brute(batches)
    # Hours at the two ends of each span and of the micro-batch, not all that came before.
    assert max(n for _, level, n in opened if level == "raw") <= 8
    # The day that has had four micro-batches is two runs at most.
    day = H._floor(F.lit(start).cast("bigint"), H.DAY)
    first = spark.range(1).select(day).first()[0]
    assert len([n for n in child_names(spark, f"{root}/tiles/day/unit={first}") if n.startswith("run=")]) <= 2


def test_old_days_are_forgotten_and_their_keys_are_not(spark):
    root = scratch_path(spark, "histories")
    write = H.history_batches(root, "k", "ts", "v", {"1h": 3600})
    days = [0, 1, 5, 9]
    for n, d in enumerate(days):
        rows = [(n, "a" if n in (0, 3) else "b", (1_704_067_200 + d * 86400) * 1_000_000 + 5, Decimal(1))]
        write(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")), n)
    write(spark.createDataFrame([], SCHEMA).withColumn("ts", F.timestamp_micros("us")), len(days))
    got = {r.i: (r.orders_1h, r.recency_s) for r in H.read_histories(spark, root).collect()}
    assert got == {0: (0, None), 1: (0, None), 2: (0, 4 * 86400), 3: (0, 9 * 86400)}
    left = [n for n in child_names(spark, f"{root}/tiles/day") if n.startswith("unit=")]
    assert len(left) == 2


def test_spans_are_whole_minutes(spark):
    with pytest.raises(ValueError):
        H.history_batches("x", "k", "ts", "v", {"90s": 90})
