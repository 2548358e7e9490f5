"""Running sums, maxima and latest values without one task per key.

A plain ``Window.partitionBy(key).orderBy(time)`` puts a whole key into one task, and a window
without keys puts everything there. Here the rows are cut into slices along the order axis. The
window runs inside one (key, slice); each slice is also reduced to one row by a grouped aggregate
(partial aggregation absorbs a hot key), and the reduced rows carry the value of all earlier slices.

Slices follow the rows: the input is dealt by range of (keys, order) and stored, so a busy minute or a
hot key spreads over as many slices as its rows need, and the input is computed once. For whole-number
axes of bounded density, such as one row per minute or value, a fixed ``width`` saves that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.functions.scalar import floor_div, join_on
from orderflow.session import stage

_FUNCTIONS = {"sum": F.sum, "max": F.max}


def _combine(kind: str, inside: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return F.when(carried.isNull(), inside).when(
        inside.isNull() | (carried > inside), carried
    ).otherwise(inside)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    width: int | None,
    outputs: dict[str, tuple[str, str]],
    include_current: bool = False,
    fan: int = 1024,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Add one running value per entry of ``outputs`` (``name -> (kind, input column)``).

    Rows with an equal ``order`` are peers, so the result does not depend on how they are sorted; with
    ``ties`` the order is (order, ties) and has no peers. By default only earlier rows count; with
    ``include_current`` the row and its peers count too. ``kind`` is ``sum`` or ``max``; the maximum
    of ``struct(time, payload…)`` is the latest payload. ``width`` is the slice size on a bigint axis,
    or None to let the rows decide. Without keys and with a width a second level of ``fan`` slices keeps
    the last, unkeyed step to one row per ``width * fan``; slices dealt by range are few.
    """
    if width is None:
        dealt = df.repartitionByRange(*keys, order, *ties).withColumn("_slice", F.spark_partition_id())
        sliced, fan = stage(dealt, "slices"), 0
    else:
        sliced = df.withColumn("_slice", floor_div(F.col(order), width))
    last = 0 if include_current else -1
    inside = Window.partitionBy(*keys, "_slice").orderBy(order, *ties)
    inside = (inside.rowsBetween if ties else inside.rangeBetween)(Window.unboundedPreceding, last)
    totals = sliced.groupBy(*keys, "_slice").agg(
        *[_FUNCTIONS[kind](source).alias(f"_t_{name}") for name, (kind, source) in outputs.items()]
    )
    carry = _carry(totals, keys, outputs, fan)
    rows = sliced.select(
        "*",
        *[
            _FUNCTIONS[kind](source).over(inside).alias(f"_i_{name}")
            for name, (kind, source) in outputs.items()
        ],
    )
    joined = join_on(rows, carry, [*keys, "_slice"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            _combine(kind, F.col(f"_i_{name}"), F.col(f"_c_{name}")).alias(name)
            for name, (kind, _) in outputs.items()
        ],
    )


def _carry(
    totals: DataFrame, keys: list[str], outputs: dict[str, tuple[str, str]], fan: int
) -> DataFrame:
    """Per (key, slice), the combined value of all earlier slices."""
    if not keys and fan:
        upper = running(
            totals.withColumnRenamed("_slice", "_pos"),
            [],
            "_pos",
            fan,
            {f"_c_{name}": (kind, f"_t_{name}") for name, (kind, _) in outputs.items()},
            fan=0,
        )
        return upper.select(
            F.col("_pos").alias("_slice"), *[f"_c_{name}" for name in outputs]
        )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return totals.select(
        *keys,
        "_slice",
        *[
            _FUNCTIONS[kind](f"_t_{name}").over(before).alias(f"_c_{name}")
            for name, (kind, _) in outputs.items()
        ],
    )
