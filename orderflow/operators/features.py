"""Feature records, latest and point-in-time values, histories and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.running import running
from orderflow.functions.scalar import floor_div, iso_timestamp


def to_feature_record(
    df: DataFrame, now: Column | None = None, key: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Tick rows to feature columns (all text) plus ``record``, the name/value list.

    The id is derived from the row, so a re-delivered record stays the same feature.
    """
    at = F.date_format(
        F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    when = F.col("datetime").cast("string")
    ticker = F.coalesce(F.col("ticker").cast("string"), F.lit(""))
    wide = df.select(
        *(keep or []),
        (F.md5(F.concat_ws("_", ticker, F.coalesce(when, F.lit("")))) if key is None else key)
        .alias("id"),
        ticker.alias("ticker"),
        F.coalesce(F.col("price").cast("string"), F.lit("0.0")).alias("price"),
        F.coalesce(when, F.lit("")).alias("datetime"),
        F.coalesce(when, at).alias("event_time"),
    )
    features = wide.columns[len(keep or []):]
    return wide.withColumn("record", name_value_list(features))


def name_value_list(columns: list[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(c).alias("FeatureName"), F.col(c).alias("ValueAsString"))
            for c in columns
        ]
    )


def long_features(df: DataFrame, key: str = "id", record: str = "record") -> DataFrame:
    """One row per (record, feature name)."""
    return df.select(key, F.explode(record).alias("_f")).select(key, "_f.FeatureName", "_f.ValueAsString")


def newest_rank(df: DataFrame, column: str) -> Column:
    """A column to find the newest row by: a text counts as the time it names, and one that names none is older than all."""
    if dict(df.dtypes)[column] != "string":
        return F.col(column)
    return F.coalesce(iso_timestamp(F.col(column)), F.timestamp_micros(F.lit(-(1 << 61))))


def online_latest(df: DataFrame, key: str, event_time: str, tie: str | None = None) -> DataFrame:
    """Newest record per key by event time. One grouped aggregate, so a hot key is reduced early.

    Records of equal time are ordered by ``tie``, or by all their
    columns, so the result does not depend on the order of rows.
    """
    rest = [c for c in df.columns if c != key]
    order = F.struct(newest_rank(df, event_time), F.col(tie) if tie else F.struct(*rest))
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def get_records(online: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Look up several keys; ids without a record come back with ``found = false``."""
    return ids.select(key).distinct().join(
        online.withColumn("found", F.lit(True)), key, "left"
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def point_in_time(
    labels: DataFrame, features: DataFrame, key: str, label_ts: str, feature_ts: str,
    payload: list[str], tie: str, width_us: int | None = None,
) -> DataFrame:
    """Each label row with the latest feature at or before its time (NULL when there is none).

    Labels and features are merged on one time axis and the latest feature is a running maximum of
    ``struct(time, tie, payload)``, cut into time slices: one shuffle of both inputs, no pairing of
    rows, and no task that holds more of a key than a range of its rows.
    """
    names = [c for c in labels.columns if c != key]
    left = labels.select(
        key,
        F.unix_micros(label_ts).alias("_at"),
        F.struct(*names).alias("_label"),
        F.lit(None).cast(_struct_type(features, feature_ts, tie, payload)).alias("_feature"),
    )
    right = features.select(
        key,
        F.unix_micros(feature_ts).alias("_at"),
        F.lit(None).cast(left.schema["_label"].dataType).alias("_label"),
        _feature_struct(feature_ts, tie, payload).alias("_feature"),
    )
    seen = running(
        left.unionByName(right), [key], "_at", width_us, {"_last": ("max", "_feature")},
        include_current=True,
    )
    return seen.filter(F.col("_label").isNotNull()).select(
        key,
        *[F.col(f"_label.{c}").alias(c) for c in names],
        F.timestamp_micros("_last.at").alias("feature_time"),
        *[F.col(f"_last.{c}").alias(c) for c in payload],
    )


def _feature_struct(feature_ts: str, tie: str, payload: list[str]) -> Column:
    return F.struct(
        F.unix_micros(feature_ts).alias("at"), F.col(tie).alias("tie"), *[F.col(c) for c in payload]
    )


def _struct_type(features: DataFrame, feature_ts: str, tie: str, payload: list[str]):
    shape = features.select(_feature_struct(feature_ts, tie, payload).alias("f"))
    return shape.schema["f"].dataType


def customer_history(
    df: DataFrame, key: str, ts: str, amount: str, spans: dict[str, int],
    width_us: int | None = None,
) -> DataFrame:
    """Per row, count and sum of the key's earlier rows within each span, and seconds since the last.

    A row counts for a later one when ``t - span <= its time < t``. Each row enters the running
    totals at its time and leaves them one span later, so any span is a difference of running sums
    and long spans need no long frames.
    """
    names = list(df.columns)
    at = F.unix_micros(ts)
    value = F.col(amount).cast("decimal(24,6)")
    zero = F.lit(0).cast("decimal(24,6)")
    row = F.struct(*names)
    nothing = F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)
    marks = [(None, at)] + [(s, at + F.lit(seconds * 1_000_000)) for s, seconds in spans.items()]
    entries = []
    for span, when in marks:
        fields = [when.alias("_at"), (row if span is None else nothing).alias("_row")]
        fields.append((at if span is None else F.lit(None).cast("bigint")).alias("_enter_at"))
        for other, _ in marks:
            hit = other == span
            fields.append(F.lit(1 if hit else 0).cast("bigint").alias(f"_n_{other or 'in'}"))
            fields.append((F.coalesce(value, zero) if hit else zero).alias(f"_v_{other or 'in'}"))
        entries.append(F.struct(*fields))
    merged = df.select(key, F.explode(F.array(*entries)).alias("_e")).select(key, "_e.*")
    outputs = {"_before": ("max", "_enter_at")}
    for span, _ in marks:
        outputs[f"_rn_{span or 'in'}"] = ("sum", f"_n_{span or 'in'}")
        outputs[f"_rv_{span or 'in'}"] = ("sum", f"_v_{span or 'in'}")
    totals = running(merged, [key], "_at", width_us, outputs).filter(F.col("_row").isNotNull())
    columns = [F.col(f"_row.{c}").alias(c) for c in names]
    for span in spans:
        columns.append((F.col("_rn_in") - F.col(f"_rn_{span}")).alias(f"orders_{span}"))
        columns.append(
            (F.col("_rv_in") - F.col(f"_rv_{span}")).cast("decimal(38,6)").alias(f"amount_{span}")
        )
    columns.append(floor_div(F.col("_at") - F.col("_before"), 1_000_000).alias("recency_s"))
    return totals.select(*columns)


def feature_quality(
    df: DataFrame, key: str, event_time: str, numeric: list[str], now: Column
) -> DataFrame:
    """Record and key counts, age of the newest record, NULLs and texts that are no number."""
    checks = []
    for c in df.columns:
        checks.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
    for c in numeric:
        text = F.col(c).cast("string")
        checks.append(
            F.count_if(text.isNotNull() & text.try_cast("double").isNull()).alias(f"bad_{c}")
        )
    return df.agg(
        F.count("*").alias("records"),
        F.countDistinct(key).alias("keys"),
        F.max(event_time).alias("newest"),
        (F.unix_seconds(now) - F.max(F.unix_seconds(event_time))).alias("age_s"),
        *checks,
    )


def expire_features(df: DataFrame, event_time: str, ttl_seconds: int, now: Column) -> DataFrame:
    """Features younger than the lifetime; a plain predicate, so partitions can be pruned."""
    limit = F.timestamp_seconds(F.unix_seconds(now) - ttl_seconds)
    return df.filter(F.col(event_time) >= limit)


def online_offline_parity(
    offline: DataFrame, online: DataFrame, key: str, event_time: str, tie: str | None = None
) -> DataFrame:
    """Keys whose online row differs from the newest offline row, or is missing on one side."""
    latest = online_latest(offline, key, event_time, tie)
    columns = [c for c in latest.columns if c != key]
    a = latest.select(key, F.struct(*columns).alias("_off"))
    b = online.select(key, F.struct(*columns).alias("_on"))
    return a.join(b, key, "full").select(
        key,
        F.when(F.col("_on").isNull(), "missing_online")
        .when(F.col("_off").isNull(), "missing_offline")
        .when(~F.col("_off").eqNullSafe(F.col("_on")), "different")
        .otherwise("equal")
        .alias("parity"),
    )


def last_minute_volume(agg: DataFrame, key: str, now: Column, max_age_seconds: int = 60) -> DataFrame:
    """Volume of the latest closed window per key, and whether it is the last minute's."""
    closed = agg.filter(F.col("window_end") <= now)
    latest = closed.groupBy(key).agg(
        F.max("window_end").alias("window_end"),
        F.max_by("total_volume", "window_end").alias("total_volume"),
    )
    return latest.withColumn(
        "is_last_minute", F.unix_seconds(now) - F.unix_seconds("window_end") <= max_age_seconds
    )
