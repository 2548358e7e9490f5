"""Digests of tables: equal copies, one change, odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.session import scratch_path
from orderflow.sources.digests import DigestedTable, digest_difference, unequal_places


def table(spark, rows, name):
    out = DigestedTable(spark, scratch_path(spark, name), "k", buckets=4)
    frame = spark.createDataFrame(rows, "k string, day string, v double").withColumn("day", F.col("day").cast("date"))
    out.write(frame, "day")
    return out


ROWS = [(f"k{i}", f"2024-01-{1 + i % 3:02d}", float(i)) for i in range(60)] + [(None, "2024-01-01", 1.0), ("x", None, None), ("k1", "2024-01-02", 1.0)]


def differences(one, other):
    return sorted(((r.key or "", r.side, r.copies) for r in digest_difference(one, other).collect()))


def test_equal_tables_differ_nowhere(spark):
    one, other = table(spark, ROWS, "one"), table(spark, ROWS[::-1], "other")
    assert unequal_places(one, other) == [] and differences(one, other) == []
    assert one.rows().count() == len(ROWS)


def test_each_kind_of_difference(spark):
    one = table(spark, ROWS, "one")
    fewer = table(spark, ROWS[1:], "fewer")
    assert len(unequal_places(one, fewer)) == 1 and differences(one, fewer) == [("k0", "missing_in_sink", 1)]
    changed = table(spark, [*ROWS[:-2], ("x", None, 2.0), ROWS[-1], ROWS[-3]], "changed")
    assert differences(one, changed) == [("", "extra_in_sink", 1), ("x", "extra_in_sink", 1), ("x", "missing_in_sink", 1)]
    # Two more copies leave an exclusive or as it was; counts and sums tell.
    twice = table(spark, [*ROWS, ROWS[5], ROWS[5]], "twice")
    assert differences(one, twice) == [("k5", "extra_in_sink", 2)]


def test_a_day_that_one_side_lacks_and_an_empty_table(spark):
    one, other, empty = table(spark, ROWS, "one"), table(spark, [r for r in ROWS if r[1] != "2024-01-03"], "other"), table(spark, [], "empty")
    assert [d[2] for d in differences(other, one)] == [1] * 20
    assert len(differences(one, empty)) == 62 and differences(empty, empty) == []
    assert sum(d[2] for d in differences(empty, one)) == len(ROWS)
