"""First arrival per key wins, over micro-batches, with a time-limited memory kept as a table.

The clock is the arrival, as in the batch operator, so the answer does not depend on where micro-batches begin and a backlog is
de-duplicated like live input. A micro-batch that spans less than the memory accepts at most one arrival a key, so one grouped minimum decides it; a
backlog takes a round more for each memory it spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions.scalar import join_on
from orderflow.operators.dedup import row_order
from orderflow.session import delete_path
from orderflow.streaming.memory import AcceptedKeys


def accept_batch(
    batch: DataFrame, batch_id: int, memory: AcceptedKeys, key: str = "order_id"
) -> tuple[DataFrame, bool] | None:
    """``_key, _clock, _seq, _rows`` of the arrivals that a micro-batch accepts, written into the memory, and whether several rows share one of
    them. None for a micro-batch without rows.

    Per key, the first arrival that is at least ``ttl`` after what is remembered is accepted, then the first that is ``ttl`` after that one. Rows
    are reduced to arrivals and arrivals to a minimum before they are shuffled.
    """
    spark, ttl, clock = batch.sparkSession, memory.ttl_us, F.unix_micros("arrival_ts")
    memory.tidy(batch_id)
    earliest, newest = batch.agg(F.min(clock), F.max(clock)).first()
    own = memory.own(batch_id)
    delete_path(spark, own)
    if earliest is None:
        return None
    at = F.struct(clock.alias("clock"), F.col("arrival_seq").alias("seq"))
    arrivals = batch.select(F.col(key).alias("_key"), at.alias("_at")).groupBy("_key", "_at").agg(F.count("*").alias("_rows"))
    known = memory.latest(batch.select(F.col(key).alias("_key")), batch_id, earliest)
    if known is None:
        open_for = arrivals
    else:
        open_for = join_on(arrivals, known, ["_key"], "left")
        open_for = open_for.filter(F.col("_known").isNull() | (F.col("_at.clock") >= F.col("_known") + ttl)).drop("_known")
    turn, several = 0, False
    while True:
        first = open_for.groupBy("_key").agg(F.min(F.struct("_at", "_rows")).alias("_first"), F.max("_at.clock").alias("_last"))
        flat = first.select(
            "_key", F.col("_first._at.clock").alias("_clock"), F.col("_first._at.seq").alias("_seq"), F.col("_first._rows").alias("_rows"), "_last"
        )
        flat.write.parquet(f"{own}/round={turn}")
        step = spark.read.schema(flat.schema).parquet(f"{own}/round={turn}")
        longer = step.filter(F.col("_last") >= F.col("_clock") + ttl)
        most_rows, more = step.agg(F.max("_rows"), F.count_if(F.col("_last") >= F.col("_clock") + ttl)).first()
        several = several or (most_rows or 0) > 1
        if not more:
            break
        turn += 1
        following = longer.select("_key", F.col("_clock").alias("_known"))
        open_for = join_on(arrivals, following, ["_key"]).filter(F.col("_at.clock") >= F.col("_known") + ttl).drop("_known")
    kept = flat.schema
    accepted = spark.read.schema(kept).option("recursiveFileLookup", True).parquet(own).drop("_last")
    return accepted, several


def mark_duplicates(batch: DataFrame, accepted: tuple[DataFrame, bool] | None, key: str = "order_id") -> DataFrame:
    """``batch`` with ``is_dup``: rows whose arrival was not accepted and, of rows that share key and arrival, all but one. Which one is
    told by the rows themselves, so a repeated run tells the same."""
    if accepted is None:
        return batch.withColumn("is_dup", F.lit(True))
    arrivals, several = accepted
    named = arrivals.withColumnsRenamed({"_key": key, "_seq": "arrival_seq"})
    met = join_on(batch.withColumn("_clock", F.unix_micros("arrival_ts")), named, [key, "_clock", "arrival_seq"], "left").drop("_clock")
    if not several:
        return met.withColumn("is_dup", F.col("_rows").isNull()).drop("_rows")
    tied = F.coalesce(F.col("_rows") > 1, F.lit(False))
    same = Window.partitionBy(key, "arrival_ts", "arrival_seq").orderBy(row_order(batch.columns))
    numbered = met.filter(tied).withColumn("is_dup", F.row_number().over(same) > 1)
    return met.filter(~tied).withColumn("is_dup", F.col("_rows").isNull()).unionByName(numbered).drop("_rows")


def flag_batch_duplicates(
    batch: DataFrame, batch_id: int, memory: str, key: str = "order_id", ttl_seconds: int = C.DEDUP_TTL_SECONDS, **layout: int
) -> DataFrame:
    """One micro-batch's twin of :func:`orderflow.operators.dedup.flag_duplicates`; adds ``is_dup``.

    ``batch`` is read several times and so should be stored or persisted; it has ``arrival_ts`` and
    ``arrival_seq``, and its key is a text. An arrival that is late by more than a micro-batch counts as a duplicate of
    what was accepted after it.
    """
    own = AcceptedKeys(batch.sparkSession, memory, ttl_seconds, **layout)
    return mark_duplicates(batch, accept_batch(batch, batch_id, own, key), key)


def dedup_within_watermark(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Event-time-bounded variant, all inside the JVM, for outputs that may drop late rows."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
