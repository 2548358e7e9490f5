"""Named queries over the given tables, each with the SQL it is checked against where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Output columns in five types that both engines share: string, bigint, double, boolean and
    zone-free timestamp. Nested values become JSON text."""
    columns = []
    for name, dtype in df.dtypes:
        column = F.col(f"`{name}`")
        if dtype.startswith("decimal") or dtype == "float":
            column = column.cast("double")
        elif dtype in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif dtype == "timestamp":
            column = column.cast("timestamp_ntz")
        elif dtype == "date":
            column = column.cast("string")
        elif dtype.startswith(("array", "map", "struct")):
            column = F.to_json(column)
        columns.append(column.alias(name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB counterpart, left out for streaming effects."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain_types(build(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
