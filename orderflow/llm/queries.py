"""The registered query of each operator: its whole table, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orderflow.llm import (
    bpe, counts, embedding_dedup, fingerprints, licenses, mixing, negatives, neighbours, ngram_join, quality, toxicity, vector_codes, warc,
)
from orderflow.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op3_mix_sources", mixing.REPORT_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


@query("op8_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


@query("op9_warc_bundles", warc.ARCHIVE_SQL)
def warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


@query("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_quality_classifier")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.report(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op7_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return counts.token_counts(read(spark, sf_dir, "documents"), pieces)


@query("op2_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(read(spark, sf_dir, "documents"))


@query("op1_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


@query("op5_nn_descent")
def nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


@query("op11_vector_codes", vector_codes.COMPRESS_SQL)
def compressed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


@query("op12_hard_negatives", negatives.MINE_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.shifted_labels(read(spark, sf_dir, "embeddings")))


@query("op13_embedding_dedup", embedding_dedup.DEDUP_SQL)
def deduplicated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))
