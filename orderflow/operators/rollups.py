"""Time rollups that keep percentiles: one row per key and minute with a quantile sketch, merged to hours and days without the raw points.

A KLL sketch of size ``k`` holds a few times ``k`` values of a group whatever its rows, merges in any order, and answers a quantile whose rank is
off by at most about ``2.3 / k ** 0.9`` of the rows (0.0109 at 400), and exactly while a group has no more than ``k`` rows. So minutes are mostly exact, and hours,
days and months are as good as a sketch of their raw points would be. Groups are reduced before the shuffle; a key that holds most rows is one sketch
a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400
P50_95_99 = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def rank_error(k: int = K) -> float:
    """Share of the rows by which the rank of an answer may be off (99 of 100 times; twice that practically never)."""
    return 2.296 / k**0.9021


def rollup(df: DataFrame, keys: list[str], ts: str, value: str, unit: str = "minute", k: int = K) -> DataFrame:
    """``keys, start, n, total, low, high, sketch`` per ``unit`` of ``ts``. Null values and NaN are left out."""
    v = F.col(value).cast("double")
    there = df.filter(v.isNotNull() & ~F.isnan(v))
    return there.groupBy(*keys, F.date_trunc(unit, ts).alias("start")).agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, k).alias("sketch"),
    )


def coarser(rollups: DataFrame, keys: list[str], unit: str | None, k: int = K) -> DataFrame:
    """Rollups merged to a longer unit (or the same one, where a unit has several rows); without a unit, over all time."""
    start = [F.date_trunc(unit, "start").alias("start")] if unit else []
    return rollups.groupBy(*keys, *start).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )


def with_quantiles(rollups: DataFrame, probabilities: dict[str, float] = P50_95_99) -> DataFrame:
    """A column for each probability: the least value that at least that share of the rows does not exceed."""
    found = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for name, p in probabilities.items()}
    return rollups.withColumns(found)


def rank_checked(rollups: DataFrame, df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float] = P50_95_99, k: int = K) -> DataFrame:
    """An audit of sketches over all time, one a key, against raw points while these exist: ``keys, n`` and for each probability whether its answer has
    a rank within twice :func:`rank_error`."""
    answers = with_quantiles(rollups, probabilities).select(*keys, *probabilities)
    v, slack = F.col(value).cast("double"), 2 * rank_error(k)
    met = df.filter(v.isNotNull() & ~F.isnan(v)).join(answers, keys)
    counts = [F.count("*").alias("n")]
    for name in probabilities:
        counts += [F.count_if(v < F.col(name)).alias(f"_below_{name}"), F.count_if(v <= F.col(name)).alias(f"_upto_{name}")]
    near = [
        ((F.col(f"_below_{name}") <= (p + slack) * F.col("n")) & (F.col(f"_upto_{name}") >= (p - slack) * F.col("n"))).alias(f"{name}_near")
        for name, p in probabilities.items()
    ]
    return met.groupBy(*keys).agg(*counts).select(*keys, "n", *near)
