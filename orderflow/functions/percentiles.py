"""Exact interpolated percentiles of numeric columns, without collecting a group in one task.

The built-in exact percentile keeps a map of all values of a group in one task's memory. Here the
values are counted per (key, value), the counts are summed up in slices, and each percentile is then
the smallest value whose running count passes its rank: an ordinary grouped minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from orderflow.functions.running import running
from orderflow.functions.scalar import join_on


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], width: int = 4096
) -> DataFrame:
    """One row per key with ``n``, and one double per entry of ``probabilities`` (``name -> p``).

    Linear interpolation between the two neighbouring ranks. NULL values are ignored; a NULL key is a
    key. Whole numbers are sorted in slices of ``width`` values, fractions in slices of their rows.
    """
    whole = isinstance(df.schema[value].dataType, IntegralType)
    own = F.col(value).cast("bigint" if whole else "double")
    counts = df.filter(own.isNotNull()).groupBy(*keys, own.alias("_v")).agg(F.count("*").alias("_cnt"))
    ranked = running(
        counts, keys, "_v", width if whole else None, {"_upto": ("sum", "_cnt")}, include_current=True
    )
    if keys:
        ranked = join_on(ranked, counts.groupBy(*keys).agg(F.sum("_cnt").alias("n")), keys)
    else:
        ranked = ranked.withColumn("n", counts.agg(F.sum("_cnt")).scalar())
    picks = []
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.min(F.when(F.col("_upto") > rank, F.col("_v"))).alias(f"_{side}_{name}"))
    picked = ranked.groupBy(*keys, "n").agg(*picks)
    outputs = []
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append(
            (lo + (hi - lo) * (position - F.floor(position))).cast("double").alias(name)
        )
    return picked.select(*keys, "n", *outputs)


def approx_percentiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """Mergeable sketch variant: one pass, rank error at most ``1 / accuracy``."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        *[
            F.percentile_approx(value, p, accuracy).alias(name)
            for name, p in probabilities.items()
        ],
    )
