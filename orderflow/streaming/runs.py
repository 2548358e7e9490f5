"""Runs of rows by key, in tiers, met by a micro-batch through Bloom filters.

Each micro-batch leaves a run of its own. Every :data:`FAN` micro-batches the last ``FAN`` runs are merged into one segment, and ``FAN`` of those into one
again, so a row is rewritten twice at most. A segment is laid out in folders by a hash of the key (``bucket``) and has an index of blocked Bloom
filters: a key belongs to one chunk of 32,768 bits and sets four of them; there are as many chunks as leave 16 bits a key, so about one strange
key in 400 passes.

Whoever asks for keys reads the runs since the last merge (fewer than ``FAN``), the index, and of the segments only the buckets that hold a key which passed. All of
it is DataFrame work; the driver sees the names of segments and the buckets that were hit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import child_names, delete_path, path_exists

FAN = 16
BUCKETS = 64
CHUNK_BITS = 1 << 15  # of one bitmap
KEYS_A_CHUNK = CHUNK_BITS // 16


@dataclass(frozen=True)
class Segment:
    """A merged segment; its name carries all that a reader needs to know beforehand."""

    first: int
    last: int
    newest_us: int
    chunks: int

    @property
    def name(self) -> str:
        return f"{self.first}_{self.last}_{self.newest_us}_{self.chunks}"

    @staticmethod
    def of(name: str) -> Segment:
        return Segment(*map(int, name.removeprefix("segment=").split("_")))

    def holds(self, first: int, last: int) -> bool:
        return self.first <= first and last <= self.last


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), key), F.lit(buckets)).cast("int")


def chunk_of(key: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), chunks).cast("int")


def bits_of(key: Column) -> Column:
    """Four places of a chunk, from 60 bits of one hash."""
    h = F.xxhash64(F.lit(1), key)
    return F.array(*[F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(CHUNK_BITS - 1)) for i in range(4)])


def has_bits(bitmap: Column, bits: Column) -> Column:
    """Whether all the places are set; a byte holds eight of them, the lowest first."""

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(bits, is_set)


class KeyedRuns:
    """Rows with a text ``_key``. A subclass says what is kept of the rows of one key, and when a segment is forgotten."""

    def __init__(self, spark: SparkSession, root: str, schema: str, fan: int = FAN, buckets: int = BUCKETS):
        self.spark, self.root, self.schema = spark, root, schema
        self.fan, self.buckets = fan, buckets

    def reduced(self, rows: DataFrame) -> DataFrame:
        """One row a key."""
        raise NotImplementedError

    def newest_us(self, rows: DataFrame) -> int:
        """A clock by which segments are forgotten; 0 where they never are."""
        return 0

    def forgotten(self, segment: Segment, newest_us: int) -> bool:
        return False

    def own(self, batch_id: int) -> str:
        """The folder of a micro-batch, which a repeated one overwrites."""
        return f"{self.root}/recent/batch_id={batch_id}"

    def _merged(self, segment: Segment) -> str:
        return f"{self.root}/merged/{segment.name}"

    def _index(self, segment: Segment) -> str:
        return f"{self.root}/index/segment={segment.name}"

    def segments(self) -> list[Segment]:
        """Complete merged segments that no other holds. The index is written last."""
        found = [Segment.of(name) for name in child_names(self.spark, f"{self.root}/index") if name.startswith("segment=")]
        found = [s for s in found if path_exists(self.spark, f"{self._index(s)}/_SUCCESS")]
        return [s for s in found if not any(o.holds(s.first, s.last) and (o.first, o.last) != (s.first, s.last) for o in found)]

    def recent(self, segments: list[Segment], before: int) -> list[int]:
        """Micro-batches before this one that are in no merged segment."""
        names = child_names(self.spark, f"{self.root}/recent")
        ids = [int(name.removeprefix("batch_id=")) for name in names if name.startswith("batch_id=")]
        return sorted(n for n in ids if n < before and not any(s.holds(n, n) for s in segments))

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)

    def hit_buckets(self, keys: DataFrame, segments: list[Segment]) -> list[str]:
        """Folders of the merged segments that may hold one of the keys: at most segments times buckets."""
        schema = "chunk int, bitmap binary, segment string"
        index = self.spark.read.schema(schema).option("basePath", f"{self.root}/index").parquet(*map(self._index, segments))
        wanted = F.explode(F.array(*[
            F.struct(F.lit(s.name).alias("segment"), chunk_of(F.col("_key"), F.lit(s.chunks)).alias("chunk")) for s in segments
        ]))
        asked = keys.select("_key", wanted.alias("at")).select("_key", "at.segment", "at.chunk")
        passed = asked.join(index, ["segment", "chunk"]).filter(has_bits(F.col("bitmap"), bits_of(F.col("_key"))))
        hits = passed.select("segment", bucket_of(F.col("_key"), self.buckets).alias("bucket")).distinct().collect()
        return [f"{self.root}/merged/{hit.segment}/bucket={hit.bucket}" for hit in hits]

    def tidy(self, batch_id: int) -> None:
        """Merge what this micro-batch finds complete. A repeated micro-batch finds it done."""
        for width in (self.fan, self.fan**2):
            if batch_id and batch_id % width == 0:
                segments = self.segments()
                first, last = batch_id - width, batch_id - 1
                if not any(s.holds(first, last) for s in segments):
                    parts = [s for s in segments if first <= s.first and s.last <= last]
                    single = [n for n in self.recent(segments, batch_id) if n >= first]
                    self._merge(first, last, [self._merged(s) for s in parts] + [self.own(n) for n in single])
                self._delete_old()

    def _merge(self, first: int, last: int, paths: list[str]) -> None:
        if not paths:
            return
        rows = self.reduced(self._rows(paths))
        segment = Segment(first, last, self.newest_us(rows), max(1, -(-rows.count() // KEYS_A_CHUNK)))
        dealt = rows.withColumn("bucket", bucket_of(F.col("_key"), self.buckets)).repartition(self.buckets, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._merged(segment))
        keys = self._rows([self._merged(segment)]).select("_key")
        chunk = chunk_of(F.col("_key"), F.lit(segment.chunks)).alias("chunk")
        bitmap = F.bitmap_construct_agg("place").alias("bitmap")
        index = keys.select(chunk, F.explode(bits_of(F.col("_key"))).alias("place")).groupBy("chunk").agg(bitmap)
        index.write.mode("overwrite").parquet(self._index(segment))

    def _delete_old(self) -> None:
        """Runs and segments that are merged into others, and segments that are forgotten."""
        segments = self.segments()
        newest = max((s.newest_us for s in segments), default=0)
        kept = {s.name for s in segments if not self.forgotten(s, newest)}
        for folder, prefix in (("index", "segment="), ("merged", "")):
            for name in child_names(self.spark, f"{self.root}/{folder}"):
                if not name.startswith("_") and name.removeprefix(prefix) not in kept:
                    delete_path(self.spark, f"{self.root}/{folder}/{name}")
        for name in child_names(self.spark, f"{self.root}/recent"):
            if name.startswith("batch_id=") and any(s.holds(*[int(name[9:])] * 2) for s in segments):
                delete_path(self.spark, f"{self.root}/recent/{name}")
