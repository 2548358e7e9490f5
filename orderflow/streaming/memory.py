"""The memory of accepted keys: what a micro-batch reads follows the micro-batch and the keys it repeats, and not the ids of a whole day.

With one-minute micro-batches a day is about 40 runs and segments (:mod:`orderflow.streaming.runs`). A segment whose newest key is
forgotten is not read, and is deleted one memory later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.streaming.runs import BUCKETS, FAN, KeyedRuns, Segment


class AcceptedKeys(KeyedRuns):
    """``_key`` and ``_clock`` (microseconds) of accepted arrivals, remembered for ``ttl_seconds`` after it."""

    def __init__(self, spark: SparkSession, root: str, ttl_seconds: int, fan: int = FAN, buckets: int = BUCKETS):
        super().__init__(spark, root, "_key string, _clock bigint", fan, buckets)
        self.ttl_us = ttl_seconds * 1_000_000

    def reduced(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("_key").agg(F.max("_clock").alias("_clock"))

    def newest_us(self, rows: DataFrame) -> int:
        return rows.agg(F.max("_clock")).first()[0] or 0

    def forgotten(self, segment: Segment, newest_us: int) -> bool:
        return segment.newest_us + 2 * self.ttl_us <= newest_us

    def latest(self, keys: DataFrame, batch_id: int, earliest_us: int) -> DataFrame | None:
        """``_key, _known``: the latest accepted clock of keys that earlier micro-batches accepted and that are remembered at ``earliest_us``;
        other keys than the asked ones may be among them."""
        segments = self.segments()
        live = [s for s in segments if s.newest_us + self.ttl_us > earliest_us]
        paths = [self.own(n) for n in self.recent(segments, batch_id)]
        if live:
            paths += self.hit_buckets(keys, live)
        if not paths:
            return None
        rows = self._rows(paths).filter(F.col("_clock") + self.ttl_us > earliest_us)
        return rows.groupBy("_key").agg(F.max("_clock").alias("_known"))
