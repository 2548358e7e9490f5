"""Keep costly columns from being computed more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, keep: list[str], columns: list[Column]) -> DataFrame:
    """Select ``keep`` and ``columns``, the latter evaluated exactly once per row.

    The optimizer pushes a filter below a projection by copying the filtered column's expression,
    which for a parsed text means parsing it again for every use. It does not push filters below a
    generator, so the columns pass through one that emits a single row.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
