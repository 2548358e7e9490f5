"""Column functions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow import constants as C

# ISO-8601 date-time text, extended form, with an optional time and offset.
ISO_EXTENDED = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?"
    r"(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
ISO_BASIC_DATE = r"^\d{8}$"
ISO_WEEK_DATE = r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])-[1-7]$"


def iso_timestamp(text: Column) -> Column:
    """Event time of an ISO-8601 text (UTC when it names no offset), NULL when it is not one.

    A plain cast also takes texts such as ``2025``, so the shape is checked first.
    """
    week_one = F.date_trunc(
        "week", F.make_date(F.substring(text, 1, 4).try_cast("int"), F.lit(1), F.lit(4))
    )
    days = (F.substring(text, 7, 2).try_cast("int") - 1) * 7 + F.substring(text, 10, 1).try_cast("int") - 1
    return (
        F.when(text.rlike(ISO_EXTENDED), F.translate(text, ",", ".").try_cast("timestamp"))
        .when(text.rlike(ISO_BASIC_DATE), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(
            text.rlike(ISO_WEEK_DATE),
            F.date_add(week_one.cast("date"), days).cast("timestamp"),
        )
    )


def region_of(customer_id: Column) -> Column:
    """Lower-cased second ``-`` token when it has a tax rate, else the default region."""
    token = F.lower(F.get(F.split(customer_id, "-"), F.lit(1)))
    return F.when(token.isin(*C.TAX_RATES), token).otherwise(F.lit(C.DEFAULT_REGION))


def value_category(amount: Column) -> Column:
    return (
        F.when(amount < F.lit(C.SMALL_BELOW).cast("decimal(24,6)"), "small")
        .when(amount > F.lit(C.LARGE_ABOVE).cast("decimal(24,6)"), "large")
        .otherwise("medium")
    )


def merchant_of(customer_id: Column, region: Column) -> Column:
    """``MERCH-<REGION>-<nnn>``, the number being the sum of the id's code points modulo 100."""
    code_points = F.aggregate(
        F.split(customer_id, ""), F.lit(0), lambda total, char: total + F.ascii(char)
    )
    return F.concat(
        F.lit("MERCH-"), F.upper(region), F.lit("-"),
        F.lpad((code_points % 100).cast("string"), 3, "0"),
    )


def half_even_average(total: Column, count: Column) -> Column:
    """``total / count`` to two places, ties to even, rounded once.

    ``total`` is decimal(38,6); the division is done on whole millionths, because a decimal quotient
    is rounded at its own scale before a second rounding could see the tie.
    """
    micros = (total * F.lit(1000000)).cast("decimal(38,0)")
    sign = F.when(micros < 0, F.lit(-1)).otherwise(F.lit(1))
    unit = count.cast("decimal(19,0)") * F.lit(10000).cast("decimal(5,0)")
    magnitude = F.abs(micros)
    rest = (magnitude % unit).cast("decimal(38,0)")
    cents = ((magnitude - rest) / unit).cast("decimal(38,0)")
    twice = rest * F.lit(2)
    up = (twice > unit) | ((twice == unit) & (cents % 2 == 1))
    exact = (cents + F.when(up, F.lit(1)).otherwise(F.lit(0))) * sign
    return (exact.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def iso_from_millis(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def correlation_id(*parts: Column) -> Column:
    """The same event always gets the same id."""
    return F.md5(F.concat_ws("_", *parts))


def money_text(amount: Column) -> Column:
    """Decimal as text with at least two places and no further trailing zeros."""
    return F.regexp_replace(amount.cast("string"), r"(\.\d\d\d*?)0+$", "$1")


def ntz(ts: Column) -> Column:
    """Zone-free timestamp, the type of the tables this library is checked against."""
    return ts.cast("timestamp_ntz")


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def floor_div(number: Column, width: int) -> Column:
    """Whole-number division rounded down, exact for any bigint (a ``/`` would go through double)."""
    step = F.lit(width).cast("bigint")
    return F.call_function("div", number - F.pmod(number, step), step)


def time_bin(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bin of ``seconds`` that holds ``ts``.

    ``unix_seconds`` rounds down, and ``pmod`` stays non-negative, so times before 1970 align too.
    """
    epoch = F.unix_seconds(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; ``keys`` come from the left side."""
    named = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_on_{k}`")) for k in keys])
    return left.join(named, same, how).drop(*[f"_on_{k}" for k in keys])
