"""Completeness, conservation, reconciliation and volume checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions import scalar as S


def _counts(df: DataFrame, keys: dict[str, Column], **flags: int) -> DataFrame:
    """Grouping keys plus one 0/1 column per flag, ready to be unioned with other streams."""
    return df.select(
        *[column.alias(name) for name, column in keys.items()],
        *[F.lit(value).cast("bigint").alias(name) for name, value in flags.items()],
    )


def _count_streams(streams: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Row counts of several streams per key, in one shuffle: union of flags, then one aggregate."""
    names = list(streams)
    frames = [
        _counts(df, keys, **{n: int(n == name) for n in names})
        for name, (df, keys) in streams.items()
    ]
    keys = list(next(iter(streams.values()))[1])
    merged = reduce(lambda a, b: a.unionByName(b), frames)
    return merged.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def window_completeness(
    entered: DataFrame, emitted: DataFrame, count: str = "total_orders",
    seconds: int = C.ORDER_WINDOW_SECONDS, breach_below: float = 95.0, ts: str = "event_time",
) -> DataFrame:
    """Emitted as percent of entered rows per window; windows seen on one side only are kept."""
    rows_in = entered.groupBy(S.time_bin(F.col(ts), seconds).alias("window_start")).agg(
        F.count("*").alias("entered")
    )
    rows_out = emitted.groupBy("window_start").agg(F.sum(count).alias("emitted"))
    joined = rows_in.join(rows_out, "window_start", "full").select(
        "window_start",
        F.coalesce("entered", F.lit(0)).alias("entered"),
        F.coalesce("emitted", F.lit(0)).alias("emitted"),
    )
    percent = F.round(F.col("emitted") * 100.0 / F.when(F.col("entered") > 0, F.col("entered")), 4)
    return joined.withColumn("completeness", percent).withColumn(
        "breach", F.coalesce(F.col("completeness") < breach_below, F.lit(True))
    )


def unaccounted_per_window(
    rows_in: DataFrame, rows_out: DataFrame, rows_late: DataFrame,
    seconds: int = C.ORDER_WINDOW_SECONDS, ts: str = "event_time",
) -> DataFrame:
    """In − out − late per window, and whether anything is missing or too much."""
    key = {"window_start": S.time_bin(F.col(ts), seconds)}
    counted = _count_streams(
        {
            "records_in": (rows_in, key),
            "records_out": (rows_out, key),
            "records_late": (rows_late, key),
        }
    )
    return unaccounted(counted)


def unaccounted_of_flags(
    rows: DataFrame, late: Column, out: Column, seconds: int = C.ORDER_WINDOW_SECONDS, ts: str = "event_time"
) -> DataFrame:
    """The same from one table whose rows say what became of them: a single grouped aggregate."""
    return unaccounted(
        rows.groupBy(S.time_bin(F.col(ts), seconds).alias("window_start")).agg(
            F.count("*").alias("records_in"), F.count_if(out).alias("records_out"), F.count_if(late).alias("records_late")
        )
    )


def unaccounted(window_stats: DataFrame) -> DataFrame:
    gap = F.col("records_in") - F.col("records_out") - F.col("records_late")
    return window_stats.withColumn("unaccounted", gap).withColumn(
        "is_error", F.col("unaccounted") != 0
    )


def late_per_window(
    flagged: DataFrame, seconds: int = C.ORDER_WINDOW_SECONDS, above_percent: float = 5.0
) -> DataFrame:
    """Late rows per window and whether they exceed the share; windows without late rows are out."""
    return (
        flagged.groupBy(S.time_bin(F.col("event_time"), seconds).alias("window_start"))
        .agg(F.count("*").alias("rows_in"), F.count_if("is_late").alias("rows_late"))
        .filter(F.col("rows_late") > 0)
        .withColumn("late_percent", F.round(F.col("rows_late") * 100.0 / F.col("rows_in"), 4))
        .withColumn("breach", F.col("late_percent") > above_percent)
    )


def missing_bins(df: DataFrame, ts: str, seconds: int, name: str) -> DataFrame:
    """Epoch-aligned bins without a row, between the first and the last seen bin.

    Found from each seen bin's successor: only gaps are expanded, so there is no calendar join. The
    windowed rows are the distinct bins; they are windowed per day, and a day's last bin is matched
    to the next seen day's first bin over one row per day.
    """
    bins = df.select(S.time_bin(F.col(ts), seconds).alias("_bin")).filter("_bin is not null").distinct()
    at = bins.select(
        F.unix_seconds("_bin").alias("_at"), S.floor_div(F.unix_seconds("_bin"), 86400).alias("_day")
    )
    inside = at.withColumn("_next", F.lead("_at").over(Window.partitionBy("_day").orderBy("_at")))
    days = at.groupBy("_day").agg(F.min("_at").alias("_first"), F.max("_at").alias("_at"))
    between = days.select(
        "_at", F.lead("_first").over(Window.orderBy("_day")).alias("_next")
    )
    gaps = inside.select("_at", "_next").unionByName(between).filter(
        F.col("_next") - F.col("_at") > seconds
    )
    step = F.lit(seconds).cast("bigint")
    return gaps.select(
        F.explode(F.sequence(F.col("_at") + step, F.col("_next") - step, step)).alias("_s")
    ).select(F.timestamp_seconds("_s").alias(name))


def missing_windows(agg: DataFrame, seconds: int = C.ORDER_WINDOW_SECONDS) -> DataFrame:
    return missing_bins(agg, "window_start", seconds, "window_start")


def hourly_gaps(df: DataFrame, ts: str) -> DataFrame:
    return missing_bins(df, ts, 3600, "hour")


def silent_minutes(df: DataFrame, ts: str) -> DataFrame:
    return missing_bins(df, ts, 60, "minute")


def conservation(
    rows_in: DataFrame, rows_out: DataFrame, rows_dlq: DataFrame, rows_late: DataFrame,
    ts: str = "arrival_ts", seconds: int = 300,
) -> DataFrame:
    """Per bin of arrival: nothing from nowhere (in >= out), and out = in − dlq − late."""
    key = {"bin_start": S.time_bin(F.col(ts), seconds)}
    counted = _count_streams(
        {
            "records_in": (rows_in, key),
            "records_out": (rows_out, key),
            "records_dlq": (rows_dlq, key),
            "records_late": (rows_late, key),
        }
    )
    return _balanced(counted)


def conservation_of_flags(
    rows: DataFrame, late: Column, out: Column, dlq: Column, ts: str = "arrival_ts", seconds: int = 300
) -> DataFrame:
    """The same from one table whose rows say what became of them."""
    return _balanced(
        rows.groupBy(S.time_bin(F.col(ts), seconds).alias("bin_start")).agg(
            F.count("*").alias("records_in"), F.count_if(out).alias("records_out"),
            F.count_if(dlq).alias("records_dlq"), F.count_if(late).alias("records_late"),
        )
    )


def _balanced(counted: DataFrame) -> DataFrame:
    balance = F.col("records_in") - F.col("records_dlq") - F.col("records_late")
    return counted.withColumn("in_covers_out", F.col("records_in") >= F.col("records_out")).withColumn(
        "conserved", F.col("records_out") == balance
    )


def uniqueness(df: DataFrame, key: str = "order_id", approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.agg(F.count("*").alias("total"), distinct.alias("distinct_keys")).withColumn(
        "is_unique", F.col("total") == F.col("distinct_keys")
    )


def dedup_ratio(flagged: DataFrame, above_percent: float = 1.0) -> DataFrame:
    return (
        flagged.agg(F.count("*").alias("rows_in"), F.count_if("is_dup").alias("duplicates"))
        .withColumn("dup_percent", F.round(F.col("duplicates") * 100.0 / F.col("rows_in"), 4))
        .withColumn("breach", F.col("dup_percent") > above_percent)
    )


def reconcile_counts(
    source: DataFrame, sink: DataFrame, rejected: DataFrame, ts: str = "arrival_ts"
) -> DataFrame:
    """Hourly source, sink and rejected counts; matched when source = sink + rejected."""
    key = {"hour": F.date_trunc("hour", ts)}
    counted = _count_streams(
        {"source_rows": (source, key), "sink_rows": (sink, key), "rejected_rows": (rejected, key)}
    )
    return counted.withColumn(
        "matched", F.col("source_rows") == F.col("sink_rows") + F.col("rejected_rows")
    )


def reconcile_totals(
    source: DataFrame, sink: DataFrame, ts: str, amount: str, alert_below: float = 99.9
) -> DataFrame:
    """Daily counts and decimal totals on both sides; alert when too little of the total arrived."""

    def side(df: DataFrame, n_source: int) -> DataFrame:
        value = F.col(amount).cast("decimal(24,6)")
        zero = F.lit(0).cast("decimal(24,6)")
        return df.select(
            F.to_date(ts).alias("day"),
            F.lit(n_source).alias("_sc"), F.lit(1 - n_source).alias("_kc"),
            (value if n_source else zero).alias("_sv"), (zero if n_source else value).alias("_kv"),
        )

    totals = (
        side(source, 1)
        .unionByName(side(sink, 0))
        .groupBy("day")
        .agg(
            F.sum("_sc").alias("source_rows"),
            F.sum("_kc").alias("sink_rows"),
            F.sum("_sv").cast("decimal(38,6)").alias("source_total"),
            F.sum("_kv").cast("decimal(38,6)").alias("sink_total"),
        )
    )
    share = F.round(
        F.col("sink_total").cast("double") * 100.0
        / F.when(F.col("source_total") != 0, F.col("source_total").cast("double")),
        4,
    )
    return totals.withColumn("percent", share).withColumn(
        "alert", F.coalesce(F.col("percent") < alert_below, F.lit(True))
    )


def sample_audit(
    source: DataFrame, sink: DataFrame, key: str, compare: list[str], n: int = 100, seed: str = "7"
) -> DataFrame:
    """``n`` pseudo-random source keys: present, unique, equal and complete in the sink?

    The sample (a top-n by hash, the feature itself) is taken first, so both joins carry n rows.
    """
    picked = (
        source.select(key).distinct()
        .withColumn("_rank", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))))
        .orderBy("_rank").limit(n).select(key)
    )

    def fold(df: DataFrame, side: str) -> DataFrame:
        return df.join(picked, key, "left_semi").groupBy(key).agg(
            F.count("*").alias(f"{side}_copies"),
            F.min(F.struct(*compare)).alias(f"_{side}"),
        )

    joined = fold(source, "source").join(fold(sink, "sink"), key, "left")
    complete = reduce(lambda a, b: a & b, [F.col(f"_sink.{c}").isNotNull() for c in compare])
    present = F.col("sink_copies").isNotNull()
    return joined.select(
        key,
        present.alias("present"),
        (F.coalesce("sink_copies", F.lit(0)) == 1).alias("is_unique"),
        (present & F.col("_source").eqNullSafe(F.col("_sink"))).alias("is_equal"),
        (present & F.coalesce(complete, F.lit(False))).alias("is_complete"),
    )


def key_difference(source: DataFrame, sink: DataFrame, key: str) -> DataFrame:
    """Keys with fewer ("missing") or more ("extra") copies in the sink than in the source.

    One union and one aggregate: the multiset difference both ways, without a join.
    """
    both = source.select(key, F.lit(1).alias("_n")).unionByName(
        sink.select(key, F.lit(-1).alias("_n"))
    )
    return (
        both.groupBy(key)
        .agg(F.sum("_n").alias("_n"))
        .filter(F.col("_n") != 0)
        .select(
            key,
            F.when(F.col("_n") > 0, "missing_in_sink").otherwise("extra_in_sink").alias("side"),
            F.abs("_n").alias("copies"),
        )
    )


def volume_spike(
    agg: DataFrame, count: str = "total_orders", trailing: int = 6, spike: float = 5.0,
    drop: float = 0.2, key: str = "region",
) -> DataFrame:
    """Each window's volume against the mean of the key's previous windows.

    The input is one row per (key, window), so a key's partition grows with time only.
    """
    before = Window.partitionBy(key).orderBy("window_start").rowsBetween(-trailing, -1)
    mean = F.avg(count).over(before)
    return agg.select(
        key,
        "window_start",
        F.col(count),
        F.round(mean, 6).alias("trailing_mean"),
        F.when(F.col(count) >= mean * spike, "spike")
        .when(F.col(count) <= mean * drop, "drop")
        .otherwise("normal")
        .alias("volume_state"),
    )


def profile_columns(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Per column: rows, NULLs, distinct values, smallest and largest value, constant or not.

    Columns become (name, value) rows, so the exact distinct counts are one ordinary two-step
    aggregate; ``approximate`` uses a mergeable sketch in a single pass instead. Smallest and largest are
    found in the column's own type, in the same scan, and turned into text at the end.
    """
    ends = df.agg(
        *[f(c).cast("string").alias(f"{name}_{i}") for i, c in enumerate(columns) for f, name in ((F.min, "min"), (F.max, "max"))]
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(f"min_{i}").alias("min_value"),
                        F.col(f"max_{i}").alias("max_value"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("_e")
    ).select("_e.*")
    pairs = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
                    for c in columns
                ]
            )
        ).alias("_p")
    ).select("_p.column_name", "_p.v")
    if approximate:
        counted = pairs.groupBy("column_name").agg(
            F.count("*").alias("row_count"),
            F.count_if(F.col("v").isNull()).alias("null_count"),
            F.approx_count_distinct("v").alias("distinct_count"),
        )
    else:
        counted = (
            pairs.groupBy("column_name", "v")
            .agg(F.count("*").alias("_n"))
            .groupBy("column_name")
            .agg(
                F.sum("_n").alias("row_count"),
                F.sum(F.when(F.col("v").isNull(), F.col("_n")).otherwise(0)).alias("null_count"),
                F.count("v").alias("distinct_count"),
            )
        )
    return counted.join(ends, "column_name").withColumn("is_constant", F.col("distinct_count") <= 1)
