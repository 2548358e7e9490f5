"""The online side of a feature store: the newest record of each key, upserted by micro-batches and looked up by key.

Upserts are runs in tiers (:mod:`orderflow.streaming.runs`), each laid out in buckets of the key. A lookup opens only buckets of its keys, and of merged
segments only those whose Bloom filter knows one of them; compaction merges bucket by bucket and never rewrites more than the segments it merges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderflow.operators.features import newest_rank
from orderflow.session import child_names
from orderflow.streaming.runs import BUCKETS, FAN, KeyedRuns, bucket_of


class UpsertedRecords(KeyedRuns):
    """Newest record per ``keys``: by ``order`` where given, then by the micro-batch, then by the record itself. ``schema`` is that of the records."""

    def __init__(
        self, spark: SparkSession, root: str, keys: list[str], schema: StructType, order: str | None = None,
        fan: int = FAN, buckets: int = BUCKETS,
    ):
        own = StructType().add("_key", "string").add("_batch", "long")
        super().__init__(spark, root, StructType([*own.fields, *schema.fields]), fan, buckets)
        self.keys, self.order, self.columns = keys, order, schema.names

    def key_of(self) -> Column:
        """The key as one text, in which null and empty differ."""
        return F.to_json(F.struct(*[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(self.keys)]))

    def reduced(self, rows: DataFrame) -> DataFrame:
        record = F.struct(*[F.col(f"`{c}`") for c in self.columns])
        rank = F.struct(*([newest_rank(rows, self.order)] if self.order else []), "_batch", record)
        return rows.groupBy("_key").agg(F.max_by(F.struct("_batch", *[F.col(f"`{c}`") for c in self.columns]), rank).alias("_r")).select("_key", "_r.*")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The run of a micro-batch: its newest record per key, by bucket. A repeated micro-batch overwrites it."""
        self.tidy(batch_id)
        rows = batch.select(self.key_of().alias("_key"), F.lit(batch_id).cast("bigint").alias("_batch"), *[F.col(f"`{c}`") for c in self.columns])
        run = self.reduced(rows).withColumn("bucket", bucket_of(F.col("_key"), self.buckets)).repartition(self.buckets, "bucket")
        run.write.mode("overwrite").partitionBy("bucket").parquet(self.own(batch_id))

    def table(self) -> DataFrame:
        """The newest record of every key."""
        segments = self.segments()
        paths = [self._merged(s) for s in segments] + [self.own(n) for n in self.recent(segments, 1 << 62)]
        return self.reduced(self._rows(paths)).select(*self.columns)

    def folders_of(self, keys: DataFrame) -> list[str]:
        """Folders that may hold one of the keys (``_key``): at most runs times buckets."""
        segments = self.segments()
        buckets = {r[0] for r in keys.select(bucket_of(F.col("_key"), self.buckets)).distinct().collect()}
        found = self.hit_buckets(keys, segments) if segments else []
        for n in self.recent(segments, 1 << 62):
            there = set(child_names(self.spark, self.own(n)))
            found += [f"{self.own(n)}/bucket={b}" for b in sorted(buckets) if f"bucket={b}" in there]
        return found

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The records of the given keys; a key without a record comes back with ``found = false``."""
        asked = ids.select(*self.keys).distinct().withColumn("_key", self.key_of())
        paths = self.folders_of(asked.select("_key"))
        rest = [c for c in self.columns if c not in self.keys]
        rows = self._rows(paths) if paths else self.spark.createDataFrame([], self.schema)
        records = self.reduced(rows).select("_key", *rest, F.lit(True).alias("found"))
        return asked.join(records, "_key", "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("_key")


def upsert_records(
    root: str, keys: list[str], order: str | None = None, fan: int = FAN, buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """The sink of a streaming query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        UpsertedRecords(batch.sparkSession, root, keys, batch.schema, order, fan, buckets).write(batch, batch_id)

    return write
