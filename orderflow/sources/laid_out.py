"""Feature history laid out for as-of lookups: blocks of a key's consecutive features, found through an index of their first times.

A block holds at most :data:`BLOCK_ROWS` features of one key and one slice of time, sorted, as one row of a table bucketed by (key, block). The index
has a row per block: its first time and its last feature. A lookup finds the block of each label as of its time in the index, which is smaller than the history by
the size of the blocks; a label at or after the last feature of its block is answered there. The others join the blocks in place: the history is
not shuffled or sorted, each block is read once, and a hot key is as many blocks, in as many buckets, as its features need.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.functions.scalar import floor_div
from orderflow.operators.features import point_in_time
from orderflow.session import stage

BLOCK_ROWS = 256
SLICE_SECONDS = 3600


@dataclass(frozen=True)
class LaidOutHistory:
    """``blocks`` is a bucketed table ``_key, _slice, _part, _features``; ``index`` has ``_key, _slice, _part, _first, _last``."""

    blocks: DataFrame
    index: DataFrame
    payload: list[str]


def lay_out(
    features: DataFrame, path: str, key: str, ts: str, payload: list[str], tie: str, buckets: int,
    block_rows: int = BLOCK_ROWS, slice_seconds: int = SLICE_SECONDS, table: str | None = None,
) -> LaidOutHistory:
    """Write the history below ``path``. Features without a time are left out. ``table`` is its name in the catalog, for later sessions (:func:`open_history`);
    without one the layout is known to this session's result alone."""
    spark = features.sparkSession
    at = F.unix_micros(ts)
    rows = features.filter(F.col(ts).isNotNull()).select(
        _key(key), floor_div(at, slice_seconds * 1_000_000).alias("_slice"),
        F.struct(at.alias("at"), F.col(tie).alias("tie"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)]).alias("_f"),
    )
    place = Window.partitionBy("_key", "_slice").orderBy("_f.at", "_f.tie")
    numbered = rows.withColumn("_part", floor_div((F.row_number().over(place) - 1).cast("bigint"), block_rows))
    blocks = numbered.groupBy("_key", "_slice", "_part").agg(F.sort_array(F.collect_list("_f")).alias("_features"))
    name = table or "laid_out_" + uuid.uuid4().hex
    dealt = blocks.repartition(buckets, "_key", "_slice", "_part")
    dealt.write.option("path", f"{path}/blocks").bucketBy(buckets, "_key", "_slice", "_part").format("parquet").saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # resolved before the name goes; the files stay
    if table is None:
        spark.sql(f"drop table {name}")
    first, last = F.col("_features")[0]["at"], F.element_at("_features", -1)
    stored.select("_key", "_slice", "_part", first.alias("_first"), last.alias("_last")).write.parquet(f"{path}/index")
    return LaidOutHistory(stored, spark.read.parquet(f"{path}/index"), payload)


def open_history(spark: SparkSession, path: str, payload: list[str], table: str) -> LaidOutHistory:
    return LaidOutHistory(spark.table(table), spark.read.parquet(f"{path}/index"), payload)


def _key(key: str):
    """As one text, in which null and empty differ, so that blocks join in place for a null key too."""
    return F.to_json(F.struct(F.col(f"`{key}`").cast("string").alias("k"))).alias("_key")


def lookup_as_of(labels: DataFrame, history: LaidOutHistory, key: str, ts: str) -> DataFrame:
    """Each label row with the latest feature at or before its time, as :func:`orderflow.operators.features.point_in_time` finds it. A label without a time finds
    none."""
    names = labels.columns
    asked = labels.select(_key(key), F.col(ts).alias("_ts"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_label"))
    index = history.index.select("_key", F.timestamp_micros("_first").alias("_begin"), F.struct("_slice", "_part").alias("_place"), "_last")
    placed = stage(point_in_time(asked, index, "_key", "_ts", "_begin", ["_place", "_last"], tie="_place"), "placed-labels")
    inside = F.coalesce(F.unix_micros("_ts") < F.col("_last.at"), F.lit(False))
    answered = placed.filter(~inside).select("_label", F.col("_last").alias("_f"))
    asking = placed.filter(inside).select("_key", "_label", F.unix_micros("_ts").alias("_at"), F.col("_place._slice").alias("_slice"), F.col("_place._part").alias("_part"))
    met = asking.join(history.blocks, ["_key", "_slice", "_part"])
    found = met.select("_label", F.element_at(F.filter("_features", lambda f: f["at"] <= F.col("_at")), -1).alias("_f"))
    return answered.unionByName(found).select(
        *[F.col(f"_label.`{c}`").alias(c) for c in names],
        F.timestamp_micros("_f.at").alias("feature_time"),
        *[F.col(f"_f.p{i}").alias(c) for i, c in enumerate(history.payload)],
    )
