"""Hour-partitioned lake: layout, writer, pruned reader, age tiers and compaction."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import few_listing_tasks

# Hour partitions, gzip Parquet, flush interval and size, days to each storage tier.
PARTITIONS = ["year", "month", "day", "hour"]
FLUSH_INTERVAL = "300 seconds"
FLUSHES_AN_HOUR = 12
TARGET_FILE_BYTES = 128 * 1024 * 1024
GLACIER_DAYS = 90
DEEP_ARCHIVE_DAYS = 365


def with_partition_columns(df: DataFrame, ts: str) -> DataFrame:
    formats = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    return df.withColumns({name: F.date_format(ts, fmt) for name, fmt in formats.items()})


def writers(spark: SparkSession) -> int:
    """As many as the session shuffles into. Named, because many small files take long however few bytes they have, and by bytes
    they would all go to one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_lake(
    df: DataFrame, path: str, ts: str, mode: str = "append", rows_per_file: int = 2_000_000
) -> None:
    """Hour-partitioned gzip Parquet with files of about ``rows_per_file`` rows.

    A first pass counts rows per hour; an hour is then spread over as many writers as it needs
    files, so quiet hours make one file and an hour with a third of all rows still has many
    writers. The counts are one row per hour.
    """
    counts = (
        with_partition_columns(df.select(ts), ts)
        .groupBy(*PARTITIONS)
        .agg(F.ceil(F.count("*") / F.lit(rows_per_file)).cast("int").alias("_files"))
    )
    (
        with_partition_columns(df, ts)
        .join(counts, PARTITIONS, "left")
        .withColumn(
            "_writer", F.pmod(F.xxhash64(*df.columns), F.coalesce("_files", F.lit(1)))
        )
        .repartition(writers(df.sparkSession), *PARTITIONS, "_writer")
        .drop("_files", "_writer")
        .write.mode(mode)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 2 * rows_per_file)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def hour_range(start: datetime, end: datetime) -> Column:
    """Partition predicate for ``start <= hour < end``; every level is constrained, so whole years
    and days are pruned before any file is listed."""
    first, last = start.replace(minute=0, second=0, microsecond=0), end - timedelta(microseconds=1)
    key = F.concat(*[F.col(p).cast("string") for p in PARTITIONS])
    years = [str(y) for y in range(first.year, last.year + 1)]
    return (
        F.col("year").isin(years)
        & (key >= first.strftime("%Y%m%d%H"))
        & (key <= last.strftime("%Y%m%d%H"))
    )


def read_lake(
    spark: SparkSession, path: str, start: datetime, end: datetime, ts: str, schema: str | None = None
) -> DataFrame:
    """Rows with ``start <= ts < end``; only partitions of that range are read."""
    rows = lake_table(spark, path, schema).filter(hour_range(start, end))
    return rows.filter(
        (F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp"))
    )


def lake_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The whole lake. Partition columns are texts, so that ``05`` stays what the folder says; the other columns come from
    ``schema`` or the files."""
    reader = spark.read.option("basePath", path)
    with few_listing_tasks(spark):
        if schema is None:
            found = reader.parquet(path).schema
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.fields if f.name not in PARTITIONS)
        return reader.schema(schema + "".join(f", {p} string" for p in PARTITIONS)).parquet(path)


def lake_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and modification time of every data file, without reading contents."""
    with few_listing_tasks(spark):
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(path)
        )
    return files.select("path", F.col("length").alias("bytes"), "modificationTime")


def partitions_of_files(files: DataFrame) -> DataFrame:
    """One row per hour partition, from the file paths."""
    parts = [F.regexp_extract("path", rf"{p}=([^/]+)", 1).alias(p) for p in PARTITIONS]
    return (
        files.select(*parts, "bytes")
        .groupBy(*PARTITIONS)
        .agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    )


def lake_age_tiers(partitions: DataFrame, today: Column, delete_after_days: int | None = None) -> DataFrame:
    """Storage tier of each partition by its age, and whether it is due for deletion."""
    day = F.make_date(*[F.col(p).cast("int") for p in PARTITIONS[:3]])
    tier = (
        F.when(F.col("age_days") >= DEEP_ARCHIVE_DAYS, "deep_archive")
        .when(F.col("age_days") >= GLACIER_DAYS, "glacier")
        .otherwise("standard")
    )
    due = F.lit(False) if delete_after_days is None else F.col("age_days") >= delete_after_days
    return (
        partitions.withColumn("age_days", F.datediff(today, day))
        .withColumn("tier", tier)
        .withColumn("delete_due", due)
    )


def compact_partitions(
    spark: SparkSession, path: str, into: str, target_bytes: int = TARGET_FILE_BYTES
) -> DataFrame:
    """Rewrite every partition of ``path`` into files near the target size, under ``into``.

    The number of files per partition comes from its measured size (one row per hour partition,
    joined back as a column), and rows are spread over that many writers. The result goes to a new
    folder, so a lost executor or a failed run leaves the source whole; the caller swaps the folders.
    """
    sizes = partitions_of_files(lake_files(spark, path)).select(
        *PARTITIONS, F.ceil(F.col("bytes") / F.lit(target_bytes)).cast("int").alias("_files")
    )
    rows = lake_table(spark, path)
    data = [c for c in rows.columns if c not in PARTITIONS]
    spread = F.pmod(F.xxhash64(*data), F.greatest("_files", F.lit(1)))
    (
        rows.join(sizes, PARTITIONS, "left")
        .withColumn("_writer", F.coalesce(spread, F.lit(0)))
        .repartition(writers(spark), *PARTITIONS, "_writer")
        .drop("_files", "_writer")
        .write.mode("overwrite")
        .option("compression", "gzip")
        .partitionBy(*PARTITIONS)
        .parquet(into)
    )
    return partitions_of_files(lake_files(spark, into))


def rows_per_hour(lake: DataFrame) -> DataFrame:
    return lake.groupBy(*PARTITIONS).agg(F.count("*").alias("rows"))
