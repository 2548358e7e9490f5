"""Tables with digests by day (or month) and bucket of the key, which two copies compare level by level: rows are read only where they differ.

A digest is the number of rows, and the sum and the exclusive or of their hashes, so it depends on no order and adds up: buckets to days. Two tables
compare their days, then the buckets of the days that differ, then the rows of the buckets that differ. Equal tables cost a row a day; one changed row
costs its day's digests and one bucket of each side. The driver sees the days and buckets that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.operators.quality import key_difference
from orderflow.session import few_listing_tasks

BUCKETS = 64
NO_DAY = "none"
_SUMS = ["n", "total", "odd"]


class DigestedTable:
    """``columns`` of rows with a ``key``, stored by the day, or what ``period`` makes of it, and a bucket of the key. Choose both so that a bucket fills a file."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS, period: str = "yyyy-MM-dd"):
        self.spark, self.root, self.key, self.buckets, self.period = spark, root, key, buckets, period

    def write(self, rows: DataFrame, day: str) -> None:
        """Store the rows and their digests, once. ``day`` is a column of dates or times; null is a day of its own."""
        own = [F.col(f"`{c}`") for c in rows.columns]
        placed = rows.select(
            *own,
            F.coalesce(F.date_format(day, self.period), F.lit(NO_DAY)).alias("_day"),
            F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int").alias("_bucket"),
        )
        # Rebalanced and not repartitioned: a bucket with a hot key is split over several tasks.
        with few_listing_tasks(self.spark):
            self._write(placed, rows.columns)

    def _write(self, placed: DataFrame, columns: list[str]) -> None:
        placed.hint("rebalance", "_day", "_bucket").write.partitionBy("_day", "_bucket").parquet(f"{self.root}/rows")
        stored = self.spark.read.schema(placed.schema).parquet(f"{self.root}/rows")
        h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)])
        digests = stored.groupBy("_day", "_bucket").agg(
            F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("odd")
        )
        digests.repartition("_day").write.partitionBy("_day").parquet(f"{self.root}/buckets")
        sums = F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("odd").alias("odd")
        self._level("buckets").groupBy("_day").agg(*sums).coalesce(1).write.parquet(f"{self.root}/days")

    def _level(self, name: str) -> DataFrame:
        bucket = "_bucket int, " if name == "buckets" else ""
        return self.spark.read.schema(f"{bucket}n bigint, total decimal(38,0), odd bigint, _day string").parquet(f"{self.root}/{name}")

    def rows(self, places: list[tuple[str, int]] | None = None) -> DataFrame:
        """All rows, or those of some days and buckets, from their folders alone."""
        if places is None:
            return self.spark.read.parquet(f"{self.root}/rows").drop("_day", "_bucket")
        paths = [f"{self.root}/rows/_day={day}/_bucket={bucket}" for day, bucket in places]
        with few_listing_tasks(self.spark):
            return self.spark.read.parquet(*paths)


def _unequal(one: DataFrame, other: DataFrame, by: list[str]) -> list[tuple]:
    """Days or buckets whose digests differ, with whether either side has them."""
    sides = [df.select(*by, F.struct(*_SUMS).alias(name)) for df, name in ((one, "one"), (other, "other"))]
    met = sides[0].join(sides[1], by, "full").filter(~F.col("one").eqNullSafe(F.col("other")))
    return [tuple(r) for r in met.select(*by, F.col("one").isNotNull(), F.col("other").isNotNull()).collect()]


def unequal_places(source: DataFrame | DigestedTable, sink: DigestedTable) -> list[tuple[str, int, bool, bool]]:
    """``(day, bucket, in source, in sink)`` of the buckets that differ."""
    days = [day for day, *_ in _unequal(source._level("days"), sink._level("days"), ["_day"])]
    if not days:
        return []
    here = F.col("_day").isin(days)
    return _unequal(source._level("buckets").filter(here), sink._level("buckets").filter(here), ["_day", "_bucket"])


def digest_difference(source: DigestedTable, sink: DigestedTable) -> DataFrame:
    """Rows with fewer ("missing") or more ("extra") copies in the sink than in the source, as ``key, row, side, copies``; a changed row is
    missing with its old and extra with its new values (``row`` is a hash of them). Only buckets that differ are read."""
    places, key = unequal_places(source, sink), source.key
    parts = []
    for table, at in ((source, 2), (sink, 3)):
        own = [(p[0], p[1]) for p in places if p[at]]
        if own:
            rows = table.rows(own)
            mark = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
            parts.append(rows.select(F.struct(F.col(f"`{key}`").alias("key"), mark.alias("row")).alias("_row")))
        else:
            parts.append(None)
    some = next((p for p in parts if p is not None), None)
    if some is None:
        return sink.spark.createDataFrame([], "key string, row bigint, side string, copies bigint")
    one, other = (p if p is not None else some.limit(0) for p in parts)
    return key_difference(one, other, "_row").select("_row.key", "_row.row", "side", "copies")
