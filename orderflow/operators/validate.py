"""Parse, validate and route raw order texts; build and replay dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow import constants as C
from orderflow.functions.once import compute_once
from orderflow.functions.scalar import iso_timestamp
from orderflow.schemas import ORDER_KEYS
from orderflow.session import stage


def _literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def classify_schema_errors(
    text: Column, document: Column, fields: Column, amount: Column, event: Column
) -> Column:
    """Why a text does not fit the order contract, or NULL.

    ``document`` is the text parsed as the only element of a list, ``fields`` its key/value map
    (NULL when it is not an object), ``amount`` and ``event`` the parsed number and time. The key
    set is strict both ways. A text with a ``]`` could close the list itself, so only such a text is
    parsed a second time, as the value of an object.
    """
    closes_list = text.contains("]") & F.try_parse_json(
        F.concat(F.lit('{"v":'), text, F.lit("}"))
    ).isNull()
    not_json = (
        document.isNull()
        | F.try_variant_get(document, "$[0]", "variant").isNull()
        | F.try_variant_get(document, "$[1]", "variant").isNotNull()
        | closes_list
    )
    keys, required = F.map_keys(fields), _literal_array(ORDER_KEYS)
    missing, extra = F.array_except(required, keys), F.array_except(keys, required)
    timestamp_is_text = (
        F.schema_of_variant(F.try_variant_get(document, "$[0].timestamp", "variant")) == "STRING"
    )
    fits = (F.size(keys) == len(ORDER_KEYS)) & (F.size(missing) == 0)
    return (
        F.when(not_json, "Invalid JSON: text is not one JSON document")
        .when(fields.isNull(), "Unexpected error: not a JSON object")
        .when(
            ~fits,
            F.concat(
                F.lit("Unexpected error: missing keys ["), F.array_join(F.sort_array(missing), ","),
                F.lit("], extra keys ["), F.array_join(F.sort_array(extra), ","), F.lit("]"),
            ),
        )
        .when(amount.isNull() | F.isnan(amount), "Unexpected error: amount is not a number")
        .when(
            fields["items_count"].try_cast("int").isNull(),
            "Unexpected error: items_count is not a whole number",
        )
        .when(fields["order_id"].isNull(), "Unexpected error: order_id is null")
        .when(fields["customer_id"].isNull(), "Unexpected error: customer_id is null")
        .when(
            event.isNull() & ~F.coalesce(timestamp_is_text, F.lit(False)),
            "Unexpected error: timestamp is not a text",
        )
    )


def parse_orders(df: DataFrame, value: str = "value") -> DataFrame:
    """Raw JSON texts to typed order columns plus ``schema_error`` (NULL when the text fits).

    Each text is parsed once. It is wrapped into a list first, because a parser that reads a single
    value stops at its end and would not see trailing characters. The steps are separate
    projections: each becomes one small generated method, and no step is computed twice.
    """
    document = F.try_parse_json(F.concat(F.lit("["), F.col(value), F.lit("]")))
    kept = df.columns
    fields, fits = F.col("_f"), F.col("schema_error").isNull()
    steps = (
        df.select(*kept, document.alias("_doc"))
        .select("*", F.try_variant_get("_doc", "$[0]", "map<string,string>").alias("_f"))
        .select(
            "*",
            fields["amount"].try_cast("double").alias("amount_double"),
            fields["amount"].try_cast("decimal(38,18)").alias("amount_exact"),
            iso_timestamp(fields["timestamp"]).alias("_event"),
        )
        .select(
            "*",
            classify_schema_errors(
                F.col(value), F.col("_doc"), fields, F.col("amount_double"), F.col("_event")
            ).alias("schema_error"),
        )
    )
    outputs = [
        F.when(fits, fields[name]).alias(name)
        for name in ("order_id", "customer_id", "currency", "status", "timestamp")
    ]
    outputs += [
        F.when(fits, F.col("amount_exact").try_cast("decimal(24,6)")).alias("amount"),
        F.col("amount_exact"),
        F.col("amount_double"),
        F.when(fits, fields["items_count"].try_cast("int")).alias("items_count"),
        F.when(fits, F.col("_event")).alias("event_time"),
        F.col("schema_error"),
    ]
    return compute_once(steps, kept, outputs)


def rule_min_amount() -> Column:
    """Compared on the exact decimal; a number beyond its range falls back to double (±infinity)."""
    low = F.coalesce(
        F.col("amount_exact") < F.lit(C.MIN_AMOUNT).cast("decimal(4,2)"), F.col("amount_double") < 0
    )
    return F.when(low, F.lit(f"Amount must be >= {C.MIN_AMOUNT}"))


def rule_max_amount() -> Column:
    high = F.coalesce(
        F.col("amount_exact") > F.lit(C.MAX_AMOUNT).cast("decimal(8,2)"), F.col("amount_double") > 0
    )
    return F.when(high, F.lit(f"Amount must be <= {C.MAX_AMOUNT}"))


def rule_currency() -> Column:
    shown = F.coalesce(F.col("currency"), F.lit("None"))
    return F.when(
        ~shown.isin(*C.CURRENCIES), F.concat(F.lit("Currency '"), shown, F.lit("' not supported"))
    )


def rule_status() -> Column:
    shown = F.coalesce(F.col("status"), F.lit("None"))
    allowed = ", ".join(sorted(C.STATUSES))
    return F.when(
        ~shown.isin(*C.STATUSES),
        F.concat(F.lit("Status '"), shown, F.lit(f"' invalid; must be one of {allowed}")),
    )


def rule_timestamp() -> Column:
    return F.when(
        F.col("event_time").isNull(),
        F.concat(F.lit("Timestamp '"), F.col("timestamp"), F.lit("' not valid ISO-8601")),
    )


RULES = [rule_min_amount, rule_max_amount, rule_currency, rule_status, rule_timestamp]


def collect_errors(df: DataFrame, rules=None) -> DataFrame:
    """Add ``errors``: every failing rule's message in rule order; empty when the order is valid."""
    rules = RULES if rules is None else rules
    return df.withColumn(
        "errors",
        F.when(F.col("schema_error").isNull(), F.array_compact(F.array(*[r() for r in rules])))
        .otherwise(F.array().cast("array<string>")),
    )


def validate_orders(df: DataFrame, value: str = "value") -> DataFrame:
    """Parse and apply every rule; adds ``error_type`` and ``error_message`` (NULL when valid)."""
    checked = collect_errors(parse_orders(df, value))
    broken = F.size("errors") > 0
    error_type = F.when(F.col("schema_error").isNotNull(), "SCHEMA_INVALID").when(
        broken, "BUSINESS_RULE_VIOLATION"
    )
    message = F.coalesce(F.col("schema_error"), F.when(broken, F.array_join("errors", "; ")))
    return compute_once(
        checked, checked.columns, [error_type.alias("error_type"), message.alias("error_message")]
    )


def route(df: DataFrame, error_type: str = "error_type") -> tuple[DataFrame, DataFrame]:
    """Split by outcome: (rows without an error, rows with one)."""
    return df.filter(F.col(error_type).isNull()), df.filter(F.col(error_type).isNotNull())


def to_dlq(
    df: DataFrame,
    at: Column,
    message: str = "value",
    order_id: str = "order_id",
    error_type: str = "error_type",
    error_message: str = "error_message",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Dead-letter records. The order id is known only when the text could be parsed.

    ``original_message`` has the length of the wire contract; ``full_message`` is the whole text, which
    replays read, so a long record is never lost.
    """
    return df.select(
        *keep,
        F.substring(F.col(message), 1, C.DLQ_MESSAGE_CHARS).alias("original_message"),
        F.col(message).alias("full_message"),
        F.col(error_type).alias("error_type"),
        F.col(error_message).alias("error_message"),
        at.alias("error_timestamp"),
        F.when(F.col(error_type) != "SCHEMA_INVALID", F.col(order_id)).alias("attempted_order_id"),
    )


def union_dlq(*frames: DataFrame) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def validate_ticks(df: DataFrame, known: list[str], min_ts: str) -> DataFrame:
    """Add ``errors`` to tick rows: unknown ticker, price that is no number, time too old."""
    price = F.col("price").cast("string").try_cast("double")
    ts = iso_timestamp(F.col("datetime").cast("string"))
    return df.withColumn(
        "errors",
        F.array_compact(
            F.array(
                F.when(
                    ~F.coalesce(F.col("ticker").isin(*known), F.lit(False)),
                    F.concat(F.lit("Unknown ticker "), F.coalesce("ticker", F.lit("None"))),
                ),
                F.when(price.isNull() | F.isnan(price), F.lit("Price is not a number")),
                F.when(
                    F.coalesce(ts < F.lit(min_ts).cast("timestamp"), F.lit(True)),
                    F.lit("Timestamp is too old"),
                ),
            )
        ),
    )


def parse_tolerant(
    df: DataFrame, aliases: dict[str, list[str]], value: str = "value"
) -> DataFrame:
    """Rewrite texts that use another name of a contract key to the contract's name.

    ``aliases`` maps a key to its other names. A non-empty value under another name wins over the
    key's own. Texts without any other name, or that are no JSON object, stay as they are.
    """
    fields = F.try_variant_get(F.try_parse_json(F.col(value)), "$", "map<string,variant>")
    others = [name for names in aliases.values() for name in names]
    touched = [*aliases, *others]
    untouched = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*touched))
    chosen = []
    for key, names in aliases.items():
        known = F.arrays_overlap(F.map_keys(fields), _literal_array([key, *names]))
        filled = [
            F.when(F.try_variant_get(fields[n], "$", "string") != "", fields[n]) for n in names
        ]
        best = F.coalesce(*filled, fields[key])
        chosen.append(F.when(known, F.struct(F.lit(key).alias("key"), best.alias("value"))))
    canonical = F.map_from_entries(F.concat(untouched, F.array_compact(F.array(*chosen))))
    renamed = F.coalesce(
        F.arrays_overlap(F.map_keys(fields), _literal_array(others)), F.lit(False)
    )
    return df.withColumn(
        value,
        F.when(renamed, F.to_json(canonical, {"ignoreNullFields": "false"})).otherwise(F.col(value)),
    )


def replay_dlq(
    dlq: DataFrame, aliases: dict[str, list[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Parse dead letters again after a fix: (recovered, still bad), two views of one stored result.

    Duplicates carry an already accepted order and are not replayed. Whole texts are read, not wire messages.
    """
    again = dlq.filter(F.col("error_type") != "DUPLICATE").select(
        F.col("full_message").alias("value"), F.col("error_type").alias("first_error_type")
    )
    if aliases:
        again = parse_tolerant(again, aliases)
    return route(stage(validate_orders(again), "replayed"))


def map_error_types(df: DataFrame, error_type: str = "error_type") -> DataFrame:
    """Add ``error_name``, the name of a dead-letter class in logs and metrics (four fixed rows)."""
    names = F.create_map(*[F.lit(x) for pair in C.ERROR_NAMES.items() for x in pair])
    return df.withColumn("error_name", F.coalesce(names[F.col(error_type)], F.lit("external_api_error")))
