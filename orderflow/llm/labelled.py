"""Bounded, reproducible samples of labelled documents, shared by the two trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import stored


def remainder(key: str, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most_rows: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``most_rows`` different labelled texts for which ``learn`` holds, by the hash of
    their ids. Only ids are sorted, and only the chosen ids (bounded by ``most_rows``) are broadcast. A label of a
    repeated id counts as 1 if one of its rows says so; of equal texts the one with the smallest id is kept."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    once = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(
        F.min(F.struct("doc_id", "y", "text")).alias("row")
    )
    return stored(once.select("row.doc_id", "row.y", "row.text"), f"labelled-{label}")
