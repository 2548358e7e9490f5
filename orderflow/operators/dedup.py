"""First arrival per key wins, remembered for a limited time from the accepted arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions.scalar import join_on
from orderflow.operators.enrich import to_wire_json
from orderflow.operators.validate import to_dlq
from orderflow.session import stage

_SALTS = 32


def flag_duplicates(
    df: DataFrame,
    key: str = "order_id",
    arrival_ts: str = "arrival_ts",
    arrival_seq: str = "arrival_seq",
    ttl_seconds: int = C.DEDUP_TTL_SECONDS,
) -> DataFrame:
    """Add ``is_dup``. A row is accepted when no earlier *accepted* row of its key is younger than
    the memory; duplicates do not refresh it. Arrivals are ordered by (arrival_ts, arrival_seq);
    ``arrival_seq`` may be a struct, as (partition, offset). Of rows that share key and arrival one is accepted, the same one in every run:
    the rows themselves tell which.
    A null key is a key.

    A key's first arrival is a grouped minimum (partial aggregation, so a hot key does not matter).
    Only keys whose arrivals span the whole memory can be accepted again; for those the next
    accepted arrival is the minimum at or after ``accepted + ttl``, one round per memory length.
    Accepted arrivals are joined back on key *and* arrival, which spreads a hot key over all tasks, and
    only keys that occur more than once take part in that join: for all others the first is the only arrival.
    """
    ttl = ttl_seconds * 1_000_000
    slim = df.select(
        F.col(key).alias("_key"),
        F.struct(
            F.unix_micros(arrival_ts).alias("clock"), F.col(arrival_seq).alias("seq")
        ).alias("_at"),
    )
    spans = stage(
        slim.groupBy("_key")
        .agg(F.min("_at").alias("_at"), F.max("_at.clock").alias("_last"), F.count("*").alias("_n"))
        .filter("_n > 1"),
        "repeated-keys",
    )
    accepted = spans.select("_key", "_at")
    again = _accepted_again(slim, spans, ttl)
    if again is not None:
        accepted = accepted.unionByName(again)
    # Rejected arrivals of repeated keys; everything else is accepted. They are few, so the rows themselves
    # meet a small table wherever the optimizer finds it small.
    arrivals = join_on(slim, spans.select("_key"), ["_key"], "left_semi").groupBy("_key", "_at").agg(F.count("*").alias("_rows"))
    first = join_on(arrivals, accepted.withColumn("_accepted", F.lit(True)), ["_key", "_at"], "left")
    special = stage(
        first.filter(F.col("_accepted").isNull() | (F.col("_rows") > 1)).select(
            F.col("_key").alias(key),
            F.timestamp_micros("_at.clock").alias(arrival_ts),
            F.col("_at.seq").alias(arrival_seq),
            F.when(F.col("_accepted"), "tied").otherwise("rejected").alias("_mark"),
        ),
        "rejected-arrivals",
    )
    marked = join_on(df, special, [key, arrival_ts, arrival_seq], "left")
    if special.filter("_mark = 'tied'").isEmpty():
        return marked.select(*df.columns, F.col("_mark").isNotNull().alias("is_dup"))
    # Several rows of one accepted arrival: all but one are duplicates. Only they are numbered.
    same = Window.partitionBy(key, arrival_ts, arrival_seq).orderBy(row_order(df.columns))
    tied = F.coalesce(F.col("_mark") == "tied", F.lit(False))
    others = marked.filter(~tied).withColumn("is_dup", F.col("_mark").isNotNull())
    return others.unionByName(marked.filter(tied).withColumn("is_dup", F.row_number().over(same) > 1)).drop("_mark")


def row_order(columns: list[str]) -> Column:
    """An order of rows by what they hold; rows that hold the same are alike in any order."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def _accepted_again(slim: DataFrame, spans: DataFrame, ttl: int) -> DataFrame | None:
    """Accepted arrivals after the first, for keys seen over more than one memory length."""
    long_keys = spans.filter(F.col("_last") - F.col("_at.clock") >= ttl).select("_key", "_at")
    salted = slim.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(_SALTS)).cast("int"))
    candidates = stage(_after(salted, long_keys, ttl), "candidates")
    found = None
    while True:
        step = stage(candidates.groupBy("_key").agg(F.min("_at").alias("_at")), "accepted-again")
        if step.isEmpty():
            return found
        found = step if found is None else found.unionByName(step)
        candidates = stage(_after(candidates, step, ttl), "candidates")


def _after(rows: DataFrame, accepted: DataFrame, ttl: int) -> DataFrame:
    """Rows of the given keys at or after ``accepted + ttl``; the salt splits a hot key's rows."""
    copies = accepted.select(
        "_key",
        F.col("_at.clock").alias("_accepted_clock"),
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"),
    )
    return (
        join_on(rows, copies, ["_key", "_salt"])
        .filter(F.col("_at.clock") >= F.col("_accepted_clock") + ttl)
        .select("_key", "_at", "_salt")
    )


def dedup_first(df: DataFrame, **options) -> DataFrame:
    return flag_duplicates(df, **options).filter(~F.col("is_dup")).drop("is_dup")


def duplicates_to_dlq(flagged: DataFrame, at: Column) -> DataFrame:
    """Dead letters of duplicate rows; they carry the enriched order, not the raw text."""
    dup = to_wire_json(flagged.filter("is_dup"), "enriched", into="_json").select(
        "_json",
        "order_id",
        F.lit("DUPLICATE").alias("error_type"),
        F.concat(
            F.lit("Order "), F.coalesce("order_id", F.lit("None")),
            F.lit(" already processed within deduplication window"),
        ).alias("error_message"),
    )
    return to_dlq(dup, at, message="_json")


def duplicate_counts(flagged: DataFrame, ts: str = "arrival_ts", limit: int = 10) -> DataFrame:
    """Duplicates per minute of arrival, and whether that exceeds the limit."""
    return (
        flagged.filter("is_dup")
        .groupBy(F.date_trunc("minute", ts).alias("minute"))
        .agg(F.count("*").alias("duplicates"))
        .withColumn("breach", F.col("duplicates") > limit)
    )
