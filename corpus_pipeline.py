"""A corpus pipeline of five of the training-data operators: toxic and poor documents go, one document of each group of near copies stays,
the sources are mixed to their target weights, and the result is encoded.

Each stage works on all that its predecessor kept and keeps the columns of the documents; the last returns the ids of the tokens as
digests, one row for each document of the mix (repeats counted). Stages read the labels beside the documents and learn from
labelled rows outside their held-out parts.

Defined cases are those of the operators. Rows with a null id are judged by their text like all others; in the n-gram stage a row stays if its id is the smallest of
its group, so rows that repeat an id and text stay or go together but for one, and rows with a null id stay only where no id links to
them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import bpe, mixing, ngram_join, quality, toxicity
from orderflow.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # trained stages; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{number + 1}")
    return docs
